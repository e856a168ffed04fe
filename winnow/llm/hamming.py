"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: principal axes and a rotation learned so that signs lose little (both fitted on a bounded
sample). A code is split into substrings and every block of rows keeps, for each substring, its distinct values with the
rows that hold them. A code within radius r of the query's agrees with it up to the share of r in at least one
substring (the pigeonhole rule, with shares that sum to r - m + 1), so probing the values within these shares
retrieves every code within r. Retrieved rows are ranked by their true distance in double precision.

The radius is the least that reaches the target recall on the sample, where neighbours are farther apart than in the
full table. A block in which a query retrieves fewer rows than it has to return widens the radius for that query, up to
all rows, so that no result is short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, prepare

SAMPLE = 8192  # distinct vectors the codes are fitted on, taken in the order of a hash of the vector
SUBSTRINGS = 8
TARGET = 0.985
ROWS = 8192  # rows of a block
QUERIES = 2048  # queries of a group


@dataclass(frozen=True)
class Codes:
    """Centre, learned axes (dimension x bits) and search radius."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes > 0


def usable(vector: Column) -> Column:
    """Not null, all components finite and not null, not zero."""
    bad = F.exists(vector, lambda v: F.isnull(v) | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _rotation(x: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Alternate between the signs and the rotation that brings the rotated rows closest to them."""
    r = np.linalg.qr(np.random.default_rng(41).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


def fit(sample: np.ndarray, k: int = 10, target: float = TARGET) -> Codes:
    """Learn axes and rotation, then the radius that finds `target` of the sample's own k nearest."""
    mean = sample.mean(0)
    _, vectors = np.linalg.eigh((sample - mean).T @ (sample - mean))
    centred = (sample - mean) @ vectors
    codes = Codes(mean, vectors @ _rotation(centred), 0)
    bits = codes.bits(sample)
    signed = np.where(bits, 1.0, -1.0)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    far = []
    for i in asked.tolist():
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        far.append((bits.shape[1] - signed[near] @ signed[i]) / 2)
    far = np.sort(np.concatenate(far)) if far else np.zeros(1)
    radius = int(far[min(len(far) - 1, int(np.ceil(target * len(far))))]) if len(far) else bits.shape[1]
    return Codes(mean, codes.axes, radius)


class Index:
    """A block of rows by the values of their substrings."""

    def __init__(self, bits: np.ndarray, parts: int):
        self.bits = bits
        self.cuts = np.array_split(np.arange(bits.shape[1]), min(parts, bits.shape[1]))
        self.signed = np.where(bits, 1, -1).astype(np.float32)
        self.tables = []
        for columns in self.cuts:
            packed = bits[:, columns] @ (1 << np.arange(len(columns), dtype=np.int64))
            order = np.argsort(packed, kind="stable")
            values, start = np.unique(packed[order], return_index=True)
            spelled = np.where((values[:, None] >> np.arange(len(columns))) & 1, 1, -1).astype(np.float32)
            self.tables.append((spelled, np.append(start, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius, found by probing the substrings' values."""
        m = len(self.cuts)
        signed = np.where(code, 1, -1).astype(np.float32)
        if radius >= self.bits.shape[1]:
            return np.arange(len(self.bits))
        found = np.zeros(len(self.bits), bool)
        share, rest = divmod(radius - m + 1, m)
        for i, (columns, (spelled, start, order)) in enumerate(zip(self.cuts, self.tables)):
            own = share + (i < rest)
            if own < 0:
                continue
            near = np.flatnonzero((len(columns) - spelled @ signed[columns]) <= 2 * own)
            for v in near.tolist():
                found[order[start[v] : start[v + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[(self.bits.shape[1] - self.signed[rows] @ signed) <= 2 * radius]


def _unpack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _search(codes: Codes, k: int, parts: int):
    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(x):
            x = x.sort_values("vec_id", kind="stable")
            ids, rows, extra = x["vec_id"].to_numpy(), _unpack(x["vector"]), x["row"].to_numpy()
            index = Index(codes.bits(rows), parts)
            asked = _unpack(q["vector"])
            for name, own, code, vector in zip(q["vec_id"], q["row"], codes.bits(asked), asked):
                radius = codes.radius
                found = index.within(code, radius)
                while len(found) < min(k + 1, len(rows)):
                    radius += 2
                    found = index.within(code, radius)
                found = found[extra[found] != own]
                d = rows[found] - vector
                score = np.sqrt(np.einsum("ij,ij->i", d, d))
                best = np.lexsort((ids[found], score))[:k]
                out.append(pd.DataFrame({"row": own, "query_id": name, "vec_id": ids[found][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})

    return search


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", sample: int = SAMPLE,
            target: float = TARGET, parts: int = SUBSTRINGS) -> DataFrame:
    """The k nearest rows of every row that `queries` marks: query_id, rank from 1, vec_id, score (the Euclidean distance).

    `queries` is a condition on vec_id. A query's own row is no candidate; other rows with its id are. Vectors that are null,
    zero, hold null or non-finite components, or differ in dimension from most of the sample take no part, nor do rows with a
    null id. Ties go to the smaller vec_id. With fewer candidates than k all are returned; an empty table gives no rows.
    Equal vectors are cut to the k + 1 smallest ids first, since no more can be among the k nearest.
    """
    spark = prepare(vectors.sparkSession)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    good = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(good)
    taken = rows.select("vector").distinct().withColumn("order", F.xxhash64("vector")).orderBy("order", "vector").limit(sample).collect()
    if not taken:
        return spark.createDataFrame([], schema)
    size = int(np.bincount([len(r["vector"]) for r in taken]).argmax())
    codes = fit(np.array([r["vector"] for r in taken if len(r["vector"]) == size]), k, target)
    rows = rows.where(F.size("vector") == size)

    few = Window.partitionBy("vector").orderBy("vec_id", "row")
    kept = rows.withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= k + 1).drop("copy")
    asked = cut(rows.where(queries))
    blocks, groups = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("row", F.lit(5)), F.lit(n))).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))
    x = deal(kept, "block", blocks, "part", groups)
    q = deal(asked, "part", groups, "block", blocks)
    found = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInPandas(
        _search(codes, k, parts), "row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
