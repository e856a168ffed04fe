"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut in two halves, each with its own codebook; the pairs of nearest centres are the cells of
a product grid. A vector visits cells in the order of a lower bound of its distance to anything they hold and stops where the
bound exceeds the distance that the cosine threshold allows: the target recall is one, by the triangle inequality. What
it meets there is verified by cosine in double precision.

A pair meets in the larger of its two home cells. Equal vectors of a label are one class with a count, so the number of links
counts them without spelling them out. Hot cells are cut into blocks compared two by two; blocks return link counts and
spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import bipartite, components, cut, prepare, runs, spanning
from winnow.llm.hamming import usable

SAMPLE = 8192  # vectors the codebooks are fitted on, taken in the order of a hash of the vector
PER_CELL = 1000  # rows of the table a product cell
MOST_CENTRES = 256
BLOCK = 1024


def codebook(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centres of x by Lloyd's rounds from evenly spaced rows; an emptied centre restarts at the row farthest from its own."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = (c**2).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        for i in range(k):
            mine = own == i
            c[i] = x[mine].mean(0) if mine.any() else x[(d.min(1) + (x**2).sum(1)).argmax()]
    return c


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home centre of every row, squared lower bound of its distance to any point whose home is each centre)."""
    d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    gap = 2 * np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 0))
    gap[gap < 1e-9] = np.inf
    low = np.zeros_like(d)
    for k in range(len(c)):
        np.maximum(low, (d - d[:, [k]]) / gap[:, k], out=low)
    home = d.argmin(1)
    low[np.arange(len(x)), home] = 0
    return home, low**2


def visits(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Cells (i * centres + j) whose bound is at most `most`, nearest first."""
    i, j = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[i], right[j]
    length = np.searchsorted(b, most - a[a <= most], side="right")
    first = np.repeat(np.arange(len(length)), length)
    second = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    order = np.argsort(a[first] + b[second], kind="stable")
    return i[first[order]] * len(right) + j[second[order]]


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_list()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _place(books: tuple[np.ndarray, np.ndarray], size: int, most: float):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            home, out = np.zeros(len(frame), np.int32), [np.zeros(0, np.int32)] * len(frame)
            own = np.flatnonzero([len(v) == size for v in frame["vector"]])
            for start in range(0, len(own), 512):
                rows = own[start : start + 512]
                x = _unit(frame["vector"].iloc[rows])
                (h1, l1), (h2, l2) = bounds(x[:, : size // 2], books[0]), bounds(x[:, size // 2 :], books[1])
                home[rows] = h1 * len(books[1]) + h2
                for r, a, b in zip(rows.tolist(), l1, l2):
                    met = visits(a, b, most)
                    out[r] = met[met > home[r]].astype(np.int32)
            yield frame.assign(home=home, visits=out)

    return place


def _links(least: float):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "size", "cell", "i", "j", "class"], kind="stable")
        names, side, count = rows["class"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[int, int]] = []
        for start, stop in runs([rows[c].to_numpy() for c in ("label", "size", "cell", "i", "j")]):
            own, at = names[start:stop], side[start:stop]
            i, j = rows["i"].iat[start], rows["j"].iat[start]
            if i == j:
                if len(own) < 2:
                    continue
                x = _unit(rows["vector"].iloc[start:stop])
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if linked.any():
                    found.append((own, linked @ count[start:stop]))
                    label = spanning(linked)
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    edges += zip(own[moved].tolist(), own[label[moved]].tolist())
            else:
                left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
                if len(left) and len(right):
                    x = _unit(rows["vector"].iloc[start:stop])
                    linked = x[left] @ x[right].T >= least
                    if linked.any():
                        n = count[start:stop]
                        found.append((own[left], linked @ n[right]))
                        found.append((own[right], n[left] @ linked))
                        edges += [(int(own[left[a]]), int(own[right[b]])) for a, b in bipartite(linked)]
        c = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        n = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        c, inverse = np.unique(c, return_inverse=True)
        n = np.bincount(inverse, n, len(c)).astype(np.int64) if len(c) else np.zeros(0, np.int64)
        some = n > 0
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({
            "class": np.concatenate([c[some], a]), "links": np.concatenate([n[some], np.zeros(len(a), np.int64)]),
            "other": pd.array([*[None] * int(some.sum()), *b.tolist()], dtype="Int64")})

    return links


def near_duplicates(vectors: DataFrame, least: float = 0.98, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id",
                    sample: int = SAMPLE, centres: int | None = None) -> DataFrame:
    """Link vectors of equal label with cosine >= least: vec_id, n_links, component_id (the smallest id reachable), kept.

    One row per row of vectors; n_links counts other rows linked directly. Vectors that are null, zero or hold null or
    non-finite components, and rows with a null label, link with nothing and are kept, as are vectors whose dimension
    differs from the other's. Repeated rows are rows of their own and link. A null vec_id takes part; its component is named by
    the least id that is not null, and a component without one has a null name and is kept. `least` must be above 0.
    `centres` per codebook follows the number of rows if not given.
    """
    spark = prepare(vectors.sparkSession)
    rows = cut(vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull()))
    good = rows.where("usable").drop("usable")
    classes = cut(good.groupBy("label", "vector").agg(
        F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")))
    taken = classes.select("vector").withColumn("order", F.xxhash64("vector")).orderBy("order", "vector").limit(sample).collect()
    sizes = np.bincount([len(r["vector"]) for r in taken], minlength=1)
    size = int(sizes.argmax())
    x = _unit(pd.Series([r["vector"] for r in taken if len(r["vector"]) == size])) if taken else np.zeros((1, size))
    k = centres or int(np.clip(2 ** round(np.log2(max(1.0, classes.count() / PER_CELL)) / 2), 2, MOST_CENTRES))
    books = codebook(x[:, : size // 2], k), codebook(x[:, size // 2 :], k)
    most = 2 - 2 * least + 1e-9

    placed = cut(classes.select("label", "vector", "class", "copies", F.size("vector").alias("size")).mapInPandas(
        _place(books, size, most),
        "label string, vector array<double>, class bigint, copies bigint, size int, home int, visits array<int>"))
    key = ["label", "size", "cell"]
    columns = [*key, "class", "copies", "vector"]
    at_home = placed.withColumnRenamed("home", "cell").select(columns)
    met = placed.select("label", "size", F.explode("visits").alias("cell"), "class", "copies", "vector")
    own = at_home.groupBy(key).agg(F.count(F.lit(1)).alias("hosted"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    other = met.groupBy(key).agg(F.count(F.lit(1)).alias("visiting"), F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("guests"))
    cells = cut(own.join(other, key, "left").fillna(0, ["visiting", "guests"]))
    # rows of the grid: a host meets all blocks and guests of its cell, a guest all blocks
    dealt = F.col("hosted") * (F.col("blocks") + F.col("guests")) + F.col("visiting") * F.col("blocks")
    bundles = -(-(cells.agg(F.sum(dealt)).first()[0] or 0) // 20_000)
    cells = cells.drop("hosted", "visiting")
    side = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    hosts = at_home.join(cells, key).withColumn("side", side(F.col("blocks"), 1)).withColumn("with", upto(F.col("blocks") + F.col("guests")))
    hosts = hosts.withColumn("i", F.when(F.col("with") < F.col("blocks"), F.least("side", "with")).otherwise(F.col("side"))).withColumn(
        "j", F.when(F.col("with") < F.col("blocks"), F.greatest("side", "with")).otherwise(F.col("with")))
    guests = met.join(cells, key).withColumn("side", F.col("blocks") + side(F.col("guests"), 2)).withColumn("i", upto(F.col("blocks"))).withColumn("j", F.col("side"))
    grid = [*columns, "side", "i", "j"]
    n = max(spark.sparkContext.defaultParallelism, bundles)
    found = cut(hosts.select(grid).unionByName(guests.select(grid)).groupBy(F.pmod(F.xxhash64(*key, "i", "j"), F.lit(n)).alias("bundle")).applyInPandas(
        _links(least), "class bigint, links bigint, other bigint"))
    groups = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))

    names = groups.join(classes.select(F.col("class").alias("node"), "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("name"))
    named = groups.join(names, "component").select(F.col("node").alias("class"), "name")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    result = cut(classes.join(counts, "class", "left").join(named, "class", "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.isnotnull("links"), F.col("name")).otherwise(F.col("least_id")).alias("component_id")))
    linked = good.join(result, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.isnull("component_id")))
