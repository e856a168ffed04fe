"""Ordered operators that do not need one task per key.

A plain window sorts all rows of a key in one task. Here a key with more than
``spark.winnow.hotRows`` rows is cut into ordered slices by a range partitioning over the key and
the order columns; the window runs inside each slice and a small table with one row per slice
carries the counts, sums or tails from the earlier slices. Keys below the limit take the plain
window, in the same stage. An empty key list means one order over the whole table.

The order columns must be unique within a key, as for any reproducible row number. Keys are taken
to be present: contracts report null keys before these operators run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.plans.cut import cut

HOT_ROWS = 2_000_000
SLICE = "_slice"
ALL = "_all"
COLD = -1  # the slice of keys below the limit; slices of hot keys count from 0


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.winnow.hotRows", str(HOT_ROWS)))


BUCKETS = 8192


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than the limit and their rows, at most rows / limit of them; None where there is none.

    A task has rows of almost as many keys as rows, so counts by key would all be shuffled. Counts by bucket of keys are few, and
    only keys of a bucket above the limit can be hot.
    """
    limit = hot_rows(df)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = [r["_b"] for r in df.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).collect()]
    if not full:
        return None
    hot = cut(df.filter(bucket.isin(full)).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys, "_n"))
    return hot if hot.first() else None


def sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count_on: DataFrame | None = None
) -> tuple[DataFrame, list[str], bool]:
    """Add a slice number; return the table, its keys and whether any key was cut.

    Key sizes are counted on `count_on`, a cheaper table with at least as many rows per key.
    """
    keys = list(keys)
    if not keys:
        df = df.withColumn(ALL, F.lit(1))
        keys = [ALL]
    hot = hot_keys(df if count_on is None else count_on, keys)
    if hot is None:
        return df.withColumn(SLICE, F.lit(COLD)), keys, False
    slices = max(2, -(-int(hot.agg(F.sum("_n")).first()[0]) // hot_rows(df)) * 2)
    hot = hot.drop("_n")
    big = df.join(hot, keys, "left_semi")
    big = big.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    # The slice number must not change when a lost task is run again, so it is written down.
    big = cut(big.withColumn(SLICE, F.spark_partition_id()))
    rest = df.join(hot, keys, "left_anti").withColumn(SLICE, F.lit(COLD))
    return rest.unionByName(big), keys, True


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, ALL)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    carry = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(SLICE).alias("_c_slice"), value)
    cond = F.col(SLICE) == F.col("_c_slice")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_c_{k}"))
    return df.join(carry, cond, "left").drop(*[f"_c_{k}" for k in keys], "_c_slice")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """row_number() over (keys order by order), exact for keys of any size."""
    df, keys, cut_any = sliced(df, keys, order)
    local = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)).cast("bigint"))
    if not cut_any:
        return _tidy(local)
    sizes = df.filter(F.col(SLICE) != COLD).groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.withColumn("_carry", F.sum("_n").over(before)).filter(F.col("_carry").isNotNull())
    joined = _attach(local, carry, keys, "_carry")
    return _tidy(joined.withColumn(out, F.col(out) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry"))


#: Running aggregates: how values fold in a slice, and how a slice's result joins those before it.
FOLDS = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, fold: str
) -> DataFrame:
    """Inclusive running sum, least or greatest value over (keys order by order), exact for keys of any size. Least and greatest pass over nulls."""
    add, join = FOLDS[fold]
    df, keys, cut_any = sliced(df, keys, order)
    upto = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(out, add(value).over(upto))
    if not cut_any:
        return _tidy(local)
    sums = df.filter(F.col(SLICE) != COLD).groupBy(*keys, SLICE).agg(add(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", add("_s").over(before)).filter(F.col("_carry").isNotNull())
    joined = _attach(local, carry, keys, "_carry")
    return _tidy(joined.withColumn(out, join(F.col(out), F.col("_carry"))).drop("_carry"))


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str = "running"
) -> DataFrame:
    """Inclusive running sum of value over (keys order by order), exact for keys of any size."""
    return with_running(df, keys, order, value, out, "sum")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, h: int, out: str = "previous",
    count_on: DataFrame | None = None,
) -> DataFrame:
    """The values of the h rows before each row, oldest first; fewer at the start of a key."""
    df, keys, cut_any = sliced(df, keys, order, count_on)
    last = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(-h, -1)
    local = df.withColumn(out, F.collect_list(value).over(last))
    if not cut_any:
        return _tidy(local)
    # Each slice hands on its last h values; h slices back always hold at least h rows.
    hot = df.filter(F.col(SLICE) != COLD)
    numbered = hot.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)))
    sizes = hot.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    ends = numbered.join(sizes, [*keys, SLICE]).filter(F.col("_rn") > F.col("_n") - h)
    tails = ends.groupBy(*keys, SLICE).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("_rn").alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-h, -1)
    carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before))).filter(F.size("_carry") > 0)
    joined = _attach(local, carry, keys, "_carry")
    merged = F.when(
        F.col("_carry").isNotNull() & (F.size(out) < h), F.concat("_carry", out)
    ).otherwise(F.col(out))
    return _tidy(joined.withColumn(out, last_items(merged, h)).drop("_carry"))


def last_items(column: Column, h: int) -> Column:
    """The last h elements of an array."""
    start = F.greatest(F.size(column) - F.lit(h), F.lit(0)) + 1
    return F.slice(column, start, h)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group with their row number.

    Up to the optimizer's group-limit threshold the filter on row_number is pushed below the
    shuffle, so a group sends at most k rows per map task; above it the sliced row number is used.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        return with_row_number(df, keys, order, out).filter(F.col(out) <= k)
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k).withColumn(out, F.col(out).cast("bigint"))


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates by a map-side combined aggregate and a join.

    A window would put every row of a group in one task; the join leaves a hot key to AQE's
    skew split, because the other side has one row per key.
    """
    if not keys:
        totals = df.agg(*aggs)
        return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])
    totals = df.groupBy(*keys).agg(*aggs)
    names = [c for c in totals.columns if c not in keys]
    totals = totals.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *names)
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_g_{k}"))
    return df.join(totals, cond, "left").drop(*[f"_g_{k}" for k in keys])
