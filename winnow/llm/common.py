"""Shared by the operators of this package: session settings, cuts, batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnow.plans.cut import checkpoint_folder
from winnow.session import ship

BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches small enough for whole, very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows, read from a table in the checkpoint folder; it outlives every executor."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/winnow/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer read tasks than cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held_out(column: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text has the given remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about `limit` bytes of text, or one longer text whole."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, fields: dict[str, str]) -> StructType:
    """The schema of df and further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items())).fields])


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for every node, component being one of its nodes.

    Every round a root hooks to its least neighbour by a hashed order and the edges are contracted, so that
    the number of live edges falls by a constant factor; no neighbour list is ever gathered. A round writes its
    parents and the live edges to the checkpoint folder; the rounds' parents are joined at the end.
    """
    spark = edges.sparkSession
    live = cut(edges.where("a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    order = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("v"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(
            F.col("a").alias("v"), F.least(order("a"), F.col("m")).getField("v").alias("p"))
        # one jump: the parent of the parent
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
        new = cut(hook.join(up, "p").select("v", F.col("g").alias("p")))
        rounds.append(new)
        a, b = (new.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        moved = live.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a node that jumped past a root keeps an edge to where that root itself goes
        roots = new.select(F.col("p").alias("a")).distinct().join(a, "a").select("a", F.col("pa").alias("b"))
        edge = F.least(order("a"), order("b")).getField("v"), F.greatest(order("a"), order("b")).getField("v")
        live = cut(moved.unionByName(roots).where("a <> b").select(edge[0].alias("a"), edge[1].alias("b")).distinct())
    if not rounds:
        kind = dict(edges.dtypes)["a"]
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    label = rounds[0]
    for new in rounds[1:]:
        label = label.join(new.select(F.col("v").alias("p"), F.col("p").alias("r")), "p", "left").select("v", F.coalesce("r", "p").alias("p"))
    return cut(label.select(F.col("v").alias("node"), F.col("p").alias("component")))


SIEVE_BITS = 1 << 24  # 2 MB whatever the number of members
_PAGE = 1 << 15  # bits of a row of a sieve


def sieve(members: DataFrame, column: str) -> DataFrame:
    """(page, bits): which of SIEVE_BITS hash values the members' column has."""
    at = F.pmod(F.xxhash64(column, F.lit(77)), F.lit(SIEVE_BITS))
    return members.select((at / _PAGE).cast("int").alias("page"), (at % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_maybe(df: DataFrame, column: str, bits: DataFrame, out: str) -> DataFrame:
    """df with a flag: false for rows whose column no member has. The sieve is broadcast; its size is bounded, and beyond it more rows pass."""
    at = F.pmod(F.xxhash64(column, F.lit(77)), F.lit(SIEVE_BITS))
    names = [free_name(df, n) for n in ("page", "bits", "bit")]
    pages = F.broadcast(bits.select(F.col("page").alias(names[0]), F.col("bits").alias(names[1])))
    joined = df.withColumn(names[0], (at / _PAGE).cast("int")).withColumn(names[2], (at % _PAGE).cast("int")).join(pages, names[0], "left")
    byte = f"cast(conv(hex(substring(`{names[1]}`, `{names[2]}` div 8 + 1, 1)), 16, 10) as int)"
    return joined.withColumn(out, F.coalesce(F.expr(f"shiftright({byte}, `{names[2]}` % 8) & 1 = 1"), F.lit(False))).drop(*names)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the least row of every row's component."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def bipartite(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of a rectangular block: (left row, right row)."""
    n, m = linked.shape
    square = np.zeros((n + m, n + m), bool)
    square[:n, n:] = linked
    square[n:, :n] = linked.T
    label = spanning(square)
    out = []
    for right in np.flatnonzero(linked.any(0)).tolist():
        out.append((int(label[n + right]), right))  # the least row of a component with a link is a left row
    for left in np.flatnonzero(linked.any(1)).tolist():
        if label[left] != left:
            out.append((left, int(np.flatnonzero(linked[left])[0])))
    return out


def runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where rows that agree in all keys begin and end, in sorted rows."""
    n = len(keys[0])
    if not n:
        return []
    change = np.zeros(n, bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    at = np.concatenate(([0], np.flatnonzero(change), [n]))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))
