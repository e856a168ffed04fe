"""Line-oriented files as a data source that knows where every row comes from.

    spark.dataSource.register(LineSource)
    spark.read.format("winnow_lines").schema(...).option("kind", "json").load(path)

A text file is cut into byte ranges, one task each; a gzip file is one task, and so is a csv file, whose quoted cells may
hold line breaks. A row that does not fit the schema stops the read with its file and line, or, with
`option("bad", "report")`, becomes a row of nulls with file, line and reason. As a stream, a micro-batch reads the files that have
come since the one before.

The reader takes filters that Spark pushes down, and applies them before rows leave it. Spark 4.1 keeps the reader it pushed filters to
with the DataFrame, so that a second query on the same DataFrame would see the filters of the first; pushing is therefore left
off, and read_where() turns it on for one read of its own.

Paths are read by the workers, so a folder must be one they share. The native readers in winnow.sources.readers are
faster and stay the default; they use this source to name the file and line of a bad row.
"""

from __future__ import annotations

import csv
import glob
import gzip
import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from winnow.plans.cut import cut

RANGE_BYTES = 64 << 20
PLACE = ("_file", "_line", "_error")


class BadLine(ValueError):
    """A row that does not fit, with its file and line."""


def listed(path: str) -> list[str]:
    """The data files at a file, folder or pattern, in order; names that begin with a dot or underscore are not data."""
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    found = [path] if os.path.isfile(path) else glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path)
    return sorted(f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))


@dataclass
class Piece(InputPartition):
    """Bytes of one file; stop is None for the whole file."""

    file: str
    start: int = 0
    stop: int | None = None


def planned(files: list[str], kind: str) -> list[Piece]:
    out = []
    for file in files:
        size = os.path.getsize(file)
        if kind == "csv" or file.endswith(".gz") or size <= RANGE_BYTES:
            out.append(Piece(file))
        else:
            out += [Piece(file, at, min(at + RANGE_BYTES, size)) for at in range(0, size, RANGE_BYTES)]
    return out


def lines_before(file: str, byte: int) -> int:
    """Line breaks before a byte; asked only when a line is bad."""
    n = 0
    with open(file, "rb") as f:
        while byte > 0:
            block = f.read(min(byte, 1 << 20))
            if not block:
                break
            n += block.count(b"\n")
            byte -= len(block)
    return n


def json_lines(piece: Piece) -> Iterator[tuple[int, int, str]]:
    """(byte, line or 0 where it is not known, text) of the lines that begin in the piece."""
    if piece.file.endswith(".gz"):
        with gzip.open(piece.file, "rt", encoding="utf-8", errors="strict") as f:
            for n, line in enumerate(f, 1):
                yield 0, n, line
        return
    with open(piece.file, "rb") as f:
        at = piece.start
        if at:  # a line that begins before the piece belongs to the piece before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while piece.stop is None or at < piece.stop:
            raw = f.readline()
            if not raw:
                break
            yield at, 0, raw.decode("utf-8", "replace")
            at += len(raw)


def fitted(value, kind, where: str = "value"):
    """A parsed JSON value as the schema's type; another one raises."""
    if value is None:
        return None
    if isinstance(kind, StringType) and isinstance(value, str):
        return value
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (LongType, IntegerType)) and isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(kind, (DoubleType, FloatType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType, f"item of {where}") for v in value]
    raise BadLine(f"{where} is {type(value).__name__}, not {kind.simpleString()}")


def typed(text: str | None, kind, where: str):
    """A csv cell as the schema's type; an empty cell of another type than string is null."""
    if text is None or isinstance(kind, StringType):
        return text
    if text == "":
        return None
    try:
        if isinstance(kind, (LongType, IntegerType)):
            return int(text)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
        if isinstance(kind, BooleanType) and text.lower() in ("true", "false"):
            return text.lower() == "true"
    except ValueError:
        pass
    raise BadLine(f"{where} is {text!r}, not {kind.simpleString()}")


def parsed(piece: Piece, kind: str, schema: StructType) -> Iterator[tuple[int, int, tuple | None, str | None]]:
    """(byte, line, row or None, reason) of every record of a piece."""
    fields = [f for f in schema.fields if f.name not in PLACE]
    if kind == "json":
        for at, line, text in json_lines(piece):
            if not text.strip():
                continue
            try:
                value = json.loads(text)
                if not isinstance(value, dict):
                    raise BadLine(f"a {type(value).__name__}, not an object")
                yield at, line, tuple(fitted(value.get(f.name), f.dataType, f.name) for f in fields), None
            except ValueError as error:
                yield at, line, None, str(error)
        return
    with (gzip.open if piece.file.endswith(".gz") else open)(piece.file, "rt", encoding="utf-8", newline="") as f:
        reader = csv.reader(f)
        header = next(reader, [])
        lost = [f.name for f in fields if f.name not in header]
        if lost:
            yield 0, 1, None, f"no column {lost[0]}"
            return
        place = [header.index(f.name) for f in fields]
        line = reader.line_num + 1
        for cells in reader:
            if cells:
                try:
                    if len(cells) != len(header):
                        raise BadLine(f"{len(cells)} cells under {len(header)} names")
                    yield 0, line, tuple(typed(cells[i], f.dataType, f.name) for i, f in zip(place, fields)), None
                except ValueError as error:
                    yield 0, line, None, str(error)
            line = reader.line_num + 1


#: What a pushed filter asks of a value that is not null.
_ASKS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
         LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def taken(rule: Filter, schema: StructType) -> bool:
    """Whether the reader applies a filter: on one top-level column that is no array, and no number that may be NaN."""
    name = getattr(rule, "attribute", ())
    if len(name) != 1 or name[0] not in schema.names or name[0] in PLACE:
        return False
    kind = schema[rule.attribute[0]].dataType
    if isinstance(rule, (IsNull, IsNotNull)):
        return True
    values = rule.value if isinstance(rule, In) else [getattr(rule, "value", None)]
    whole = all(v is not None and not (isinstance(v, float) and math.isnan(v)) for v in values)
    return (type(rule) in _ASKS or isinstance(rule, EqualNullSafe)) and isinstance(kind, (StringType, LongType, IntegerType, BooleanType)) and whole


def passes(row: tuple, names: list[str], rules: list[Filter]) -> bool:
    for rule in rules:
        value = row[names.index(rule.attribute[0])]
        if isinstance(rule, IsNull):
            ok = value is None
        elif isinstance(rule, IsNotNull):
            ok = value is not None
        else:
            ok = value is not None and (value == rule.value if isinstance(rule, EqualNullSafe) else _ASKS[type(rule)](value, rule.value))
        if not ok:
            return False
    return True


class _Lines:
    """What batch and stream share: planning is per file, reading per piece."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.kind, self.report = options.get("kind", "json"), options.get("bad", "fail") == "report"
        if self.kind not in ("json", "csv"):
            raise ValueError(f"kind must be json or csv, not {self.kind!r}")
        self.rules: list[Filter] = []

    def read(self, partition: Piece) -> Iterator[tuple]:
        names = [n for n in self.schema.names if n not in PLACE]
        placed = [n in PLACE for n in self.schema.names]
        for at, line, row, reason in parsed(partition, self.kind, self.schema):
            if row is None:
                line = line or lines_before(partition.file, at) + 1
                if not self.report:
                    raise BadLine(f"{partition.file}:{line}: {reason}")
                row = (None,) * len(names)
                where = {"_file": partition.file, "_line": line, "_error": reason}
            else:
                where = {}
            if self.rules and not passes(row, names, self.rules) and reason is None:
                continue
            values = iter(row)
            yield tuple(where.get(n) if p else next(values) for n, p in zip(self.schema.names, placed))


class LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return planned(listed(self.path), self.kind) or [Piece("")]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class PushedReader(LineReader):
    """A reader that takes filters, for one query; Spark refuses it where pushing is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for rule in filters:
            if taken(rule, self.schema) and not self.report:
                self.rules.append(rule)
            else:
                yield rule


class LineStream(_Lines, DataSourceStreamReader):
    """The offset is the number of files seen in the order of their arrival; a file must be complete when it appears."""

    def initialOffset(self) -> dict:
        return {"seen": "[]"}

    def latestOffset(self) -> dict:
        return {"seen": json.dumps(listed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before = set(json.loads(start["seen"]))
        return planned([f for f in json.loads(end["seen"]) if f not in before], self.kind) or [Piece("")]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class LineSource(DataSource):
    """Options: path; kind = json (default) or csv with a header; bad = fail (default) or report; push = true to take filters."""

    @classmethod
    def name(cls) -> str:
        return "winnow_lines"

    def schema(self) -> str:
        raise ValueError("give a schema: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("push") == "true" else LineReader)(schema, options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineStream(schema, dict(self.options))


PUSHED = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(LineSource)


def read_lines(spark: SparkSession, path: str, schema: str, kind: str = "json", bad: str = "fail") -> DataFrame:
    """The records of line files; with bad="report" also _file, _line and _error, which are null for good rows."""
    register(spark)
    if bad == "report":
        schema = f"{schema}, _file string, _line bigint, _error string"
    return spark.read.format("winnow_lines").schema(schema).option("kind", kind).option("bad", bad).load(path)


def read_where(spark: SparkSession, path: str, schema: str, where: str, kind: str = "json") -> DataFrame:
    """The records that a condition keeps, filtered in the reader as far as it can, written once to the checkpoint folder."""
    before = spark.conf.get(PUSHED, "false")
    spark.conf.set(PUSHED, "true")
    try:
        register(spark)
        rows = spark.read.format("winnow_lines").schema(schema).option("kind", kind).option("push", "true").load(path)
        return cut(rows.filter(where))
    finally:
        spark.conf.set(PUSHED, before)


def bad_lines(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """(_file, _line, _error) of the rows that do not fit the schema."""
    return read_lines(spark, path, schema, kind, "report").filter("_error is not null").select(*PLACE)
