"""Vectors, sketches and units that built-in column expressions cover."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.keys import hash48, seeded, uniform
from winnow.functions.vectors import dot_with, mean_by, minus, norm, squared_distance
from winnow.plans.cut import cut
from winnow.plans.ordered import top_per_group, with_group
from winnow.plans.partials import array_sum, stack


def count_sketch(long: DataFrame, id: str, feature: str, value: str, dim: int, seed: int) -> DataFrame:
    """(id, bucket, s): the signed sum of features per hash bucket, summed map-side."""
    name = F.concat(F.lit(f"{seed}|"), F.col(feature).cast("string"))
    hashed = long.select(id, F.col(value).alias("_x"), hash48(name).alias("_h"))  # one digest per feature
    signed = hashed.select(
        id, (F.floor(F.col("_h") / 2) % dim).cast("int").alias("bucket"), F.when(F.col("_h") % 2 == 0, F.col("_x")).otherwise(-F.col("_x")).alias("_x")
    )
    return signed.groupBy(id, "bucket").agg(F.sum("_x").alias("s"))


def sketch_array(v: str, width: int, dim: int, seed: int) -> Column:
    """Count sketch of a fixed-width vector, with the position as the feature name."""
    import hashlib

    terms: list[list[Column]] = [[] for _ in range(dim)]
    for i in range(width):
        h = int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)
        x = F.element_at(v, i + 1).cast("double")
        terms[(h // 2) % dim].append(x if h % 2 == 0 else -x)
    return F.array(*[sum(t[1:], t[0]) if t else F.lit(0.0) for t in terms])


def projection_matrix(width: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, dim)) / np.sqrt(dim)


def times(df: DataFrame, v: str, matrix: np.ndarray, out: str) -> DataFrame:
    """Add out = v @ matrix by one product per Arrow batch."""

    @F.pandas_udf("array<double>")
    def product(s: pd.Series) -> pd.Series:
        return pd.Series(list(stack(s) @ matrix)) if len(s) else pd.Series([], dtype=object)

    return df.withColumn(out, product(F.col(v)))


def random_projection(df: DataFrame, v: str, width: int, dim: int, seed: int = 0, out: str = "projected") -> DataFrame:
    if dim < 1:
        raise ValueError("a projection has at least one dimension")
    return times(df, v, projection_matrix(width, dim, seed), out)


def history_sensitive(full: DataFrame, controls: DataFrame, id: str, v: str) -> DataFrame:
    """(id, v): the full vector minus the mean of its controls; rows without a control drop out."""
    mean = mean_by(controls, [id], v, out="_mean")
    return full.join(mean, id).select(id, minus(v, "_mean").alias(v))


def alignment(df: DataFrame, v: str, reference: DataFrame, ref_v: str, cosine: bool = True, out: str = "score") -> DataFrame:
    """Add out: signed cosine (or dot) with the mean reference vector; a vanishing centroid is an error."""
    centroid = np.asarray(mean_by(reference, [], ref_v).first()["m"], dtype=float)
    size = float(np.linalg.norm(centroid))
    if size < 1e-12:
        raise ValueError("reference centroid vanishes")
    value = dot_with(v, centroid)
    return df.withColumn(out, value / (F.greatest(norm(v), F.lit(1e-30)) * F.lit(size)) if cosine else value)


def explode_codes(df: DataFrame, id: str, code: str) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.explode(code).alias("c")).select("id", "c.atom", "c.w")


def signed_units(codes: DataFrame, id: str, code: str, min_records: int = 8, min_ess: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """Membership (record_id, unit, p) and units (unit, atom, sign, support, ess) of each atom and sign."""
    long = explode_codes(codes, id, code).withColumn("sign", F.when(F.col("w") > 0, 1).otherwise(-1)).withColumn("mass", F.abs("w"))
    long = long.filter("mass > 0")
    units = long.groupBy("atom", "sign").agg(
        F.sum("mass").alias("_s"), F.sum(F.col("mass") * F.col("mass")).alias("_ss"),
        F.sum(F.when(F.col("mass") > 1e-12, 1).otherwise(0)).alias("support"),
    )
    units = units.filter((F.col("support") >= min_records) & (F.col("_s") > 1e-12)).withColumn("ess", F.col("_s") * F.col("_s") / F.col("_ss"))
    units = units.filter(F.col("ess") >= min_ess).withColumn(
        "unit", F.concat(F.lit("atom_"), F.col("atom").cast("string"), F.when(F.col("sign") > 0, "_positive").otherwise("_negative"))
    )
    member = long.join(units.select("atom", "sign", "unit", "_s"), ["atom", "sign"]).select(
        F.col("id").alias("record_id"), "unit", (F.col("mass") / F.col("_s")).alias("p")
    )
    return member, units.select("unit", "atom", "sign", "support", "ess")


def categorical_units(df: DataFrame, id: str, category: str) -> DataFrame:
    """(record_id, unit, p): uniform inside each category."""
    rows = with_group(df.select(F.col(id).alias("record_id"), F.col(category).cast("string").alias("unit")), ["unit"], F.count("*").alias("_n"))
    return rows.select("record_id", "unit", (F.lit(1.0) / F.col("_n")).alias("p"))


def nominate_rows(df: DataFrame, id: str, code: str, a: str, m: int, per_atom: int = 2) -> DataFrame:
    """(id): the best row of every objective and the rows with the largest codes of every atom."""
    best = df.agg(F.array(*[F.max_by(F.col(id), F.struct(F.element_at(a, i + 1), -F.col(id))) for i in range(m)]).alias("ids"))
    by_atom = explode_codes(df, id, code).withColumn("_abs", F.round(F.abs("w"), 12))
    top = top_per_group(by_atom, ["atom"], [F.col("_abs").desc(), F.col("id")], per_atom, "_rn").select("id")
    return best.select(F.explode("ids").alias("id")).union(top).distinct()


def cover_radius(df: DataFrame, a: str, queried: list[Sequence[float]]) -> DataFrame:
    """(radius): the largest distance of a row's responses to the nearest queried responses."""
    if not queried:
        raise ValueError("nonempty subset required")
    held = np.asarray(queried, dtype=float)

    @F.pandas_udf("double")
    def nearest(s: pd.Series) -> pd.Series:
        x = stack(s)
        best = np.full(len(x), np.inf)
        for start in range(0, len(held), 256):
            part = held[start : start + 256]
            best = np.minimum(best, np.abs(x[:, None, :] - part[None, :, :]).max(2).min(1))
        return pd.Series(best)

    return df.select(nearest(F.col(a)).alias("_d")).agg(F.max("_d").alias("radius"))


def farthest_first(df: DataFrame, id: str, v: str, k: int, seed: int = 0, every: int = 16) -> list:
    """k ids: the first by seeded digest, then each time the row farthest from those chosen.

    The distance to the chosen set is a column; every few rounds it is written down, so that a
    round computes only the distances to the rows chosen since. One aggregate per round.
    """
    pool = cut(df.select(F.col(id).alias("id"), F.col(v).alias("v")))
    first = pool.agg(F.min_by(F.struct("id", "v"), seeded(seed, "id")).alias("b")).first()["b"]
    chosen, point = [first["id"]], first["v"]
    table = pool.withColumn("d", F.expr("double('infinity')"))
    while len(chosen) < k:
        table = table.withColumn("d", F.least("d", squared_distance("v", point)))
        if len(chosen) % every == 0:
            table = cut(table)
        rest = table.filter(~F.col("id").isin(chosen))
        best = rest.agg(F.expr("max_by(struct(id, v), struct(round(d, 12), -id))").alias("b")).first()["b"]
        if best is None:
            raise ValueError(f"{k} rows asked for, {len(chosen)} there")
        chosen.append(best["id"])
        point = best["v"]
    return chosen


def _nearest(held: np.ndarray):
    """The squared distance of a vector to the nearest of the held ones."""

    @F.pandas_udf("double")
    def near(s: pd.Series) -> pd.Series:
        x = stack(s)
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(np.maximum(((x**2).sum(1)[:, None] - 2 * x @ held.T + (held**2).sum(1)).min(1), 0.0))

    return near


def spread_rows(df: DataFrame, id: str, v: str, k: int, seed: int = 0, passes: int = 4, factor: int = 2) -> list:
    """Up to k vectors far apart, in passes + 1 passes whatever k.

    Every pass draws factor * k rows with chances that grow with the squared distance to all rows drawn before (an exponential race on
    seeded digests, so that the smallest keys win); among these few, the driver takes farthest first. Ids are unique.
    """
    pool = cut(df.select(F.col(id).alias("id"), F.col(v).cast("array<double>").alias("v")))
    first = pool.agg(F.min_by(F.struct("id", "v"), seeded(seed, "id")).alias("b")).first()["b"]
    if first is None:
        return []
    held = np.asarray([first["v"]], dtype=float)
    for n in range(passes):
        raced = pool.select("id", "v", _nearest(held)(F.col("v")).alias("d"), uniform(f"{seed}-{n}", "id").alias("u")).filter("d > 1e-18")
        key = F.round(-F.log(F.greatest("u", F.lit(1e-300))) / F.col("d"), 12)
        drawn = raced.orderBy(key, "id").select("v").limit(factor * k).collect()
        if not drawn:
            break
        held = np.vstack([held, np.asarray([r["v"] for r in drawn], dtype=float)])
    chosen = [0]
    far = np.square(held - held[0]).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(held - held[chosen[-1]]).sum(1))
    return [held[i].tolist() for i in chosen]


def vector_clusters(df: DataFrame, id: str, v: str, k: int, seed: int, fit: DataFrame | None = None, floor: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Membership (record_id, unit, p) of k-means groups with at least `floor` rows, and the centers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(id).alias("record_id"), array_to_vector(F.col(v)).alias("features"))
    sample = rows if fit is None else fit.select(array_to_vector(F.col(v)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(sample.select("features"))
    labels = model.transform(rows).select("record_id", F.col("prediction").cast("string").alias("unit"))
    labels = with_group(labels, ["unit"], F.count("*").alias("_n")).filter(F.col("_n") >= floor)
    return labels.select("record_id", "unit", (F.lit(1.0) / F.col("_n")).alias("p")), np.asarray(model.clusterCenters())


def gram(df: DataFrame, v: str, width: int) -> np.ndarray:
    """Sum of outer products of a vector column."""
    return array_sum(df, [v], width * width, lambda f: (stack(f[v]).T @ stack(f[v])).ravel()).reshape(width, width)


