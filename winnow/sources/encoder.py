"""A record encoder as a table function: one input row to no record, one or many.

    register(spark)
    spark.sql("select * from encode_records(table(turns), 'package.module:function')")

The function takes a row and yields records, as mappings with the fields of an SFT record; it is found by its name, as a
job's configuration would give it, and must be importable on the workers. Its name is resolved when the query is
analysed, so a wrong one fails before any task runs. What it yields is checked by encode().
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from winnow import schemas
from winnow.operators.contracts import require_clean, sft_violations, table_violations

#: schemas.SFT without a session, which the worker that analyses a call does not have.
SFT = StructType([StructField(n, StringType() if t == "string" else ArrayType(IntegerType())) for n, t in (f.split() for f in schemas.SFT.split(", "))])
FIELDS = SFT.names


def named(encoder: str) -> Callable[[Row], Iterator[dict]]:
    """The function that 'package.module:function' names."""
    module, _, function = encoder.partition(":")
    if not function:
        raise ValueError(f"an encoder is named package.module:function, not {encoder!r}")
    return getattr(importlib.import_module(module), function)


class _Encode:
    """The handler of encode_records."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, encoder: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument of encode_records is a table")
        if not encoder.isConstantExpression or not isinstance(encoder.value, str):
            raise ValueError("the second argument of encode_records is the encoder's name")
        named(encoder.value)
        return AnalyzeResult(schema=SFT)

    def __init__(self):
        self.function = None

    def eval(self, rows: Row, encoder: str):
        if self.function is None:
            self.function = named(encoder)
        for record in self.function(rows):
            unknown = sorted(record.keys() - set(FIELDS))
            if unknown:
                raise ValueError(f"{encoder} yields a field that records do not have: {unknown[0]}")
            yield tuple(record.get(f) for f in FIELDS)


def register(spark: SparkSession, name: str = "encode_records") -> None:
    spark.udtf.register(name, udtf(_Encode))


def encode(rows: DataFrame, encoder: str, check: bool = True) -> DataFrame:
    """SFT records of all rows; a record that breaks the contract of records or of their table raises."""
    spark = rows.sparkSession
    register(spark)
    out = spark.sql("select * from encode_records(table(select * from {rows}), {encoder})", rows=rows, encoder=encoder)
    if check:
        require_clean(sft_violations(out), encoder)
        require_clean(table_violations(out), encoder)
    return out


def _bucket(text: str, n: int) -> int:
    """winnow.functions.keys.stable_bucket for one text."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) % n


def words(row: Row, vocabulary: int = 32_000) -> Iterator[dict]:
    """An encoder of turns (conv_id, turn, prompt, response): words by hash, the response supervised; none without a response."""
    if row["response"] is None or row["prompt"] is None:
        return
    root = str(row["conv_id"])
    prompt, response = ([_bucket(w, vocabulary) for w in row[c].split(" ")] for c in ("prompt", "response"))
    at = _bucket(root, 1000)
    split = next(s for end, s in ((700, "train"), (800, "select"), (900, "tune"), (950, "audit"), (1000, "test")) if at < end)
    yield {
        "record_id": f"{root}:{row['turn']}", "root_id": root, "task": "chat", "domain": "opening" if row["turn"] == 0 else "followup",
        "source": "conversations", "split": split, "input_ids": prompt + response, "labels": [schemas.MASKED] * len(prompt) + response,
        "recipe_id": f"words-{vocabulary}", "user_id": f"u{_bucket('user' + root, 50)}", "label_origin": "observed"}
