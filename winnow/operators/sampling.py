"""Order-free, seeded sampling: reservoirs, strata, draws, negatives and base distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.keys import seeded, uniform
from winnow.plans.cut import cut
from winnow.plans.ordered import top_per_group, with_running_sum

SMALL = 100_000


def digest_cutoff(digests: DataFrame, k: int, column: str = "h") -> str | None:
    """The k-th smallest of a column of distinct hex digests; None when there are fewer than k.

    Hex digests are uniform, so counting by four more digits narrows the search 65,536-fold per
    pass, until the rest is small enough for an ordered limit.
    """
    prefix, left = "", k
    while True:
        inside = digests.filter(F.col(column).startswith(prefix)) if prefix else digests
        if left <= SMALL:
            last = inside.orderBy(column).limit(left).agg(F.count("*").alias("n"), F.max(column).alias("h")).first()
            return last["h"] if last["n"] == left else None
        counts = inside.groupBy(F.substring(column, len(prefix) + 1, 4).alias("d")).agg(F.count("*").alias("n"))
        for row in sorted(counts.collect(), key=lambda x: x["d"]):  # at most 65,536 rows
            if left <= row["n"]:
                prefix += row["d"]
                break
            left -= row["n"]
        else:
            return None


def root_reservoir(df: DataFrame, root: str, k: int, seed: int = 42) -> DataFrame:
    """All rows of the k roots with the smallest seeded digest; nested in k, free of row order.

    The draw ends in one cutoff digest, so keeping the rows is a filter in the scan and needs no
    join and no list of roots.
    """
    if k < 1:
        raise ValueError("a reservoir holds at least one root")
    roots = df.select(seeded(seed, root).alias("h")).distinct()
    cutoff = digest_cutoff(roots, k)
    return df if cutoff is None else df.filter(seeded(seed, root) <= F.lit(cutoff))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per stratum without replacement."""
    drawn = top_per_group(df.withColumn("_h", seeded(seed, key)), list(strata), [F.col("_h")], n, "_rn")
    return drawn.drop("_h", "_rn")


GRID = 2**52
SPAN = 4096  # grid cells unfolded from one row at a time


def integer_masses(dist: DataFrame, p: str, out: str = "_m") -> DataFrame:
    """Add out: p as a whole number of parts, 2^52 for the largest p times the number of rows at most; rows without a part go.

    Sums of whole numbers do not depend on the order or the number of partitions.
    """
    total = dist.agg(F.sum(p).alias("t")).first()["t"]
    if total is None or not total > 0:
        raise ValueError("a distribution needs positive mass")
    # The total's last bits depend on the order of summation; rounding it to 40 bits takes them away.
    scale = float(f"{total:.11e}")
    return dist.withColumn(out, F.round(F.col(p) / F.lit(scale) * F.lit(float(GRID))).cast("bigint")).filter(F.col(out) > 0)


def weighted_draws(dist: DataFrame, key: str, p: str, draws: int, seed: int) -> DataFrame:
    """(draw, key): draws with replacement from the distribution p.

    Rows own adjoining intervals of whole numbers, so every draw falls into exactly one, whatever the partitioning. Draws and
    intervals meet on a grid cell with about one draw: an equality join with a short filter, never all pairs. A heavy row
    unfolds its cells span by span, after a shuffle, so that no task unfolds them all.
    """
    if draws < 1:
        raise ValueError("at least one draw")
    rows = with_running_sum(integer_masses(dist, p).select(key, "_m"), [], [F.col(key)], "_m", "_hi")
    rows = cut(rows.select(key, (F.col("_hi") - F.col("_m")).alias("_lo"), "_hi"))
    total = rows.agg(F.max("_hi").alias("t")).first()["t"]
    width = max(1, -(-total // draws))

    first, last = F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width}")
    spans = rows.withColumn("_from", F.explode(F.sequence(first, last, F.lit(SPAN).cast("bigint")))).withColumn("_to", F.least(last, F.col("_from") + SPAN - 1))
    cells = spans.repartition(F.col("_from")).withColumn("_cell", F.explode(F.sequence("_from", "_to"))).select(key, "_lo", "_hi", "_cell")
    spark = dist.sparkSession
    place = F.least(F.floor(uniform(seed, F.col("id")) * F.lit(float(total))).cast("bigint"), F.lit(total - 1))
    u = spark.range(draws).select(F.col("id").alias("draw"), place.alias("_u")).withColumn("_cell", F.expr(f"_u div {width}"))
    return u.join(cells, "_cell").filter("_u >= _lo and _u < _hi").select("draw", key)


def two_stage_draws(df: DataFrame, domain: str, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, key): a uniform domain first, then a uniform record of it."""
    share = base_distribution(df, domain, "equal_domains")
    return weighted_draws(share, key, "p", draws, seed)


def hard_negatives(positives: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_id, negative): the best-ranked candidate other than the answer, else a catalog item.

    positives: (record_id, domain, answer); candidates: (record_id, item_id, rank).
    """
    answers = positives.select("record_id", "answer")
    wrong = candidates.join(answers, "record_id").filter(F.col("item_id") != F.col("answer"))
    best = wrong.groupBy("record_id").agg(F.min_by("item_id", "rank").alias("_best"))
    # Two items per domain are enough for one that is not the answer.
    first = top_per_group(catalog.select("domain", "item_id").distinct(), ["domain"], [F.col("item_id")], 2, "_rn")
    spare = first.groupBy("domain").agg(
        F.min(F.when(F.col("_rn") == 1, F.col("item_id"))).alias("_one"),
        F.min(F.when(F.col("_rn") == 2, F.col("item_id"))).alias("_two"),
    )
    rows = positives.join(best, "record_id", "left").join(spare, "domain", "left")
    fallback = F.when(F.col("_one") != F.col("answer"), F.col("_one")).otherwise(F.col("_two"))
    return rows.select("record_id", F.coalesce("_best", fallback).alias("negative"))


def gumbel(p: Column, u: Column) -> Column:
    return F.log(p) - F.log(-F.log(u))


def categorical_pick(df: DataFrame, group: Sequence[str], item: str, p: str, seed: int) -> DataFrame:
    """One item per group drawn from p: the largest of log p plus Gumbel noise."""
    key = gumbel(F.col(p), uniform(seed, *group, item))
    return df.filter(F.col(p) > 0).groupBy(*group).agg(F.max_by(item, key).alias("pick"))


def speculative_pick(df: DataFrame, group: Sequence[str], item: str, target: str, draft: str, seed: int) -> DataFrame:
    """Draw from the draft, accept with min(1, target/draft), else draw from the residual."""
    noise = gumbel(F.col(draft), uniform(f"{seed}-draft", *group, item))
    rest = F.greatest(F.col(target) - F.col(draft), F.lit(0.0))
    again = F.when(rest > 0, gumbel(F.when(rest > 0, rest), uniform(f"{seed}-rest", *group, item)))
    drawn = df.groupBy(*group).agg(
        F.max_by(F.struct(F.col(item).alias("item"), F.col(target).alias("t"), F.col(draft).alias("d")),
                 F.when(F.col(draft) > 0, noise)).alias("_d"),
        F.max_by(item, again).alias("_r"),
    )
    accept = uniform(f"{seed}-accept", *group) * F.col("_d.d") < F.col("_d.t")
    # With equal laws there is no residual and a rejection has probability zero.
    accepted = accept | F.col("_r").isNull()
    return drawn.select(*group, F.when(accepted, F.col("_d.item")).otherwise(F.col("_r")).alias("pick"), accepted.alias("accepted"))


def base_distribution(df: DataFrame, domain: str, mode: str, only: str | None = None) -> DataFrame:
    """Add p: one domain, proportional to size, or equal mass per domain and uniform inside it."""
    if mode == "single":
        df = df.filter(F.col(domain) == only)
        n = df.agg(F.count("*").alias("n")).select("n").scalar()
        return df.withColumn("p", F.lit(1.0) / n)
    if mode == "proportional":
        n = df.agg(F.count("*").alias("n")).select("n").scalar()
        return df.withColumn("p", F.lit(1.0) / n)
    if mode != "equal_domains":
        raise ValueError(f"no base distribution {mode!r}")
    sizes = df.groupBy(domain).agg(F.count("*").alias("_n"))
    domains = sizes.agg(F.count("*").alias("d")).select("d").scalar()
    return df.join(sizes, domain).withColumn("p", F.lit(1.0) / (domains * F.col("_n"))).drop("_n")
