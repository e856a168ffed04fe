"""Ranking metrics, simple rankers and comparisons of runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.plans.ordered import last_items, top_per_group


def gain(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1)


def ranking_per_query(queries: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """recall, ndcg, invalid and returned slots of each query.

    An item outside the catalog or already emitted keeps its slot and scores nothing.
    queries: (query_id, domain, task, targets, predictions); catalog: (domain, item_id).
    """
    rows = queries.select(
        "query_id", "domain", "task", F.array_distinct("targets").alias("_truth"), F.slice("predictions", 1, k).alias("_top")
    )
    slots = rows.select("query_id", "domain", "task", "_truth", "_top", F.posexplode_outer("_top").alias("_pos", "item_id"))
    slots = slots.select(
        "query_id", "domain", "task", F.size("_truth").alias("_n_truth"), "_pos", "item_id",
        (F.array_position("_top", F.col("item_id")) - 1 == F.col("_pos")).alias("_first"),
        F.array_contains("_truth", F.col("item_id")).alias("_true"),
    )
    known = catalog.select("domain", "item_id").distinct().withColumn("_known", F.lit(True))
    slots = slots.join(known, ["domain", "item_id"], "left")
    valid = F.coalesce(F.col("_known") & F.col("_first"), F.lit(False))
    hit = valid & F.coalesce(F.col("_true"), F.lit(False))
    used = F.col("item_id").isNotNull()
    per = slots.groupBy("query_id", "domain", "task", "_n_truth").agg(
        F.sum(F.when(hit, 1).otherwise(0)).alias("_hits"),
        F.sum(F.when(hit, gain(F.col("_pos") + 1)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(used & ~valid, 1).otherwise(0)).alias("invalid_slots"),
        F.sum(F.when(used, 1).otherwise(0)).alias("returned_slots"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n_truth"))), F.lit(0.0), lambda acc, i: acc + gain(i)
    )
    return per.select(
        "query_id", "domain", "task", (F.col("_hits") / F.col("_n_truth")).alias("recall"),
        (F.col("_dcg") / ideal).alias("ndcg"), "invalid_slots", "returned_slots",
    )


def ranking_summary(per_query: DataFrame) -> DataFrame:
    """(level, task, domain, queries, recall, ndcg, invalid_rate) for groups, micro and macro."""
    groups = per_query.groupBy("task", "domain").agg(
        F.count("*").alias("queries"), F.sum("recall").alias("sr"), F.sum("ndcg").alias("sn"),
        F.sum("invalid_slots").alias("inv"), F.sum("returned_slots").alias("ret"),
    )
    rate = F.col("inv") / F.greatest(F.col("ret"), F.lit(1))
    each = groups.select(
        F.lit("group").alias("level"), "task", "domain", "queries", (F.col("sr") / F.col("queries")).alias("recall"),
        (F.col("sn") / F.col("queries")).alias("ndcg"), rate.alias("invalid_rate"),
    )
    # Both overall rows come from the small group table.
    both = groups.agg(
        F.sum("queries").alias("queries"), F.sum("sr").alias("sr"), F.sum("sn").alias("sn"), F.sum("inv").alias("inv"),
        F.sum("ret").alias("ret"), F.avg(F.col("sr") / F.col("queries")).alias("mr"), F.avg(F.col("sn") / F.col("queries")).alias("mn"),
    )
    levels = F.array(
        F.struct(F.lit("micro").alias("level"), (F.col("sr") / F.col("queries")).alias("recall"), (F.col("sn") / F.col("queries")).alias("ndcg")),
        F.struct(F.lit("macro").alias("level"), F.col("mr").alias("recall"), F.col("mn").alias("ndcg")),
    )
    overall = both.select(F.explode(levels).alias("l"), "queries", rate.alias("invalid_rate")).select(
        "l.level", F.lit("*").alias("task"), F.lit("*").alias("domain"), "queries", "l.recall", "l.ndcg", "invalid_rate"
    )
    return each.unionByName(overall)


def query_violations(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, rule) for repeated or empty ids, unknown domains, empty truth, targets outside the catalog."""
    repeated = queries.groupBy("query_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        "query_id", F.lit("duplicate_query").alias("rule")
    )
    empty = F.filter(
        F.array(
            F.when(F.coalesce(F.length("query_id"), F.lit(0)) == 0, F.lit("empty_query_id")),
            F.when(F.size("targets") == 0, F.lit("empty_truth")),
        ),
        lambda x: x.isNotNull(),
    )
    simple = queries.select("query_id", F.explode(empty).alias("rule"))
    domains = catalog.select("domain").distinct()
    unknown = queries.join(domains, "domain", "left_anti").select("query_id", F.lit("unknown_domain").alias("rule"))
    wanted = queries.select("query_id", "domain", F.explode(F.array_distinct("targets")).alias("item_id"))
    outside = (
        wanted.join(catalog.select("domain", "item_id").distinct(), ["domain", "item_id"], "left_anti")
        .select("query_id", F.lit("target_outside_catalog").alias("rule")).distinct()
    )
    return repeated.unionByName(simple).unionByName(unknown).unionByName(outside)


def rank_of(truth: Column | str, candidates: Column | str) -> Column:
    """1-based rank of the truth in a candidate list, null when absent."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    t = F.col(truth) if isinstance(truth, str) else truth
    position = F.array_position(c, t)
    return F.when(position > 0, position)


def rank_scores(rank: Column, cutoff: int) -> tuple[Column, Column]:
    hit = rank.isNotNull() & (rank <= cutoff)
    return F.when(hit, 1.0).otherwise(0.0), F.when(hit, gain(rank)).otherwise(0.0)


def rank_metrics(df: DataFrame, truth: str, candidates: str, cutoffs: tuple[int, ...] = (10, 20)) -> DataFrame:
    """One row: n and mean recall and ndcg at each cutoff."""
    ranked = df.select(rank_of(truth, candidates).alias("rank"))
    aggs = [F.count("*").alias("n")]
    for c in cutoffs:
        recall, ndcg = rank_scores(F.col("rank"), c)
        aggs += [F.avg(recall).alias(f"recall_{c}"), F.avg(ndcg).alias(f"ndcg_{c}")]
    return ranked.agg(*aggs)


def paired_bootstrap(left: DataFrame, right: DataFrame, repeats: int = 2000, seed: int = 22056) -> DataFrame:
    """NDCG@10 of left minus right over the same records, with a 95% percentile interval of multinomial resamples.

    left, right: (record_id, rank). A difference depends on two ranks of 1 to 10 or none, so the records come down to at most
    121 counts in one aggregate, and a resample of the records is a multinomial draw of these counts.
    """
    def place(side: str) -> Column:
        rank = F.col(f"{side}.rank")
        return F.when(rank <= 10, rank.cast("int")).otherwise(0).alias(f"_{side}")

    l, r = left.select("record_id", "rank", F.lit(1).alias("_in")).alias("l"), right.select("record_id", "rank", F.lit(1).alias("_in")).alias("r")
    met = l.join(r, F.col("l.record_id") == F.col("r.record_id"), "full_outer").select(
        place("l"), place("r"), (F.isnull("l._in") | F.isnull("r._in")).alias("_odd"))
    cells = met.groupBy("_l", "_r", "_odd").agg(F.count("*").alias("n")).collect()  # at most 363 rows
    if any(c["_odd"] for c in cells):
        raise ValueError(f"paired records differ: {sum(c['n'] for c in cells if c['_odd'])} stand on one side only")
    if not cells:
        raise ValueError("no records to compare")
    gains = np.append(0.0, 1.0 / np.log2(np.arange(2, 12)))
    cells.sort(key=lambda c: (c["_l"], c["_r"]))
    difference = np.array([gains[c["_l"]] - gains[c["_r"]] for c in cells])
    counts = np.array([c["n"] for c in cells])
    n = int(counts.sum())
    drawn = np.random.default_rng(seed).multinomial(n, counts / n, size=repeats)
    low, high = np.quantile(drawn @ difference / n, [0.025, 0.975])
    return left.sparkSession.createDataFrame(
        [(float(counts @ difference / n), float(low), float(high), n)], "difference double, low double, high double, records bigint"
    )


def popularity_ranker(train: DataFrame, k: int) -> DataFrame:
    """(domain, popular): the k most frequent items of each domain, ties by item."""
    counts = train.groupBy("domain", "item_id").agg(F.count("*").alias("n"))
    top = top_per_group(counts, ["domain"], [F.col("n").desc(), F.col("item_id")], k, "rn")
    ordered = F.sort_array(F.collect_list(F.struct("rn", "item_id")))
    return top.groupBy("domain").agg(F.transform(ordered, lambda s: s["item_id"]).alias("popular"))


def history_then_popularity(
    rows: DataFrame, train: DataFrame, k: int, depth: int | None = None, history_limit: int = 20
) -> DataFrame:
    """Add predictions: history items newest first (the last `depth` of them), then popular items, no repeats."""
    # Even if every history item is popular, k + |history| popular items fill the list.
    popular = popularity_ranker(train, k + (history_limit if depth is None else depth))
    past = F.reverse("history" if depth is None else last_items(F.col("history"), depth))
    merged = F.slice(F.array_distinct(F.concat(past, F.coalesce("popular", F.array().cast("array<string>")))), 1, k)
    # One row per domain on the right: Spark broadcasts it when its size allows.
    return rows.join(popular, "domain", "left").withColumn("predictions", merged).drop("popular")


def method_summary(runs: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds per method and metric."""
    aggs = [F.count("*").alias("runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return runs.groupBy(method).agg(*aggs)


def cost_comparison(runs: DataFrame, method: str, fixed: str) -> DataFrame:
    """Total seconds per method and its overhead over the fixed one.

    runs: (method, train_seconds, selection_seconds, representation_seconds).
    """
    totals = runs.groupBy(method).agg(
        (F.sum("train_seconds") + F.sum("selection_seconds") + F.sum("representation_seconds")).alias("total_seconds")
    )
    base = totals.filter(F.col(method) == fixed).agg(F.max("total_seconds").alias("b")).select("b").scalar()
    return totals.withColumn("overhead", F.col("total_seconds") / base - 1.0)


def best_run(stages: DataFrame, group: str, order: str, scores: list[str], label: str) -> DataFrame:
    """Per group the first stage whose score is within 1e-12 of the best, for each score.

    The initial stage is a row like any other and stays eligible.
    """
    peaks = stages.groupBy(group).agg(*[F.max(s).alias(f"_p_{s}") for s in scores])
    rows = stages.join(peaks, group)
    picked = [
        F.min_by(label, F.when(F.col(s) >= F.col(f"_p_{s}") - 1e-12, F.col(order))).alias(f"best_by_{s}") for s in scores
    ]
    return rows.groupBy(group).agg(*picked)


def window_diagnostics(windows: DataFrame, method: str, response: str, mass: str) -> DataFrame:
    """Windows per method, those with a nonpositive predicted response, and the mean domain mass."""
    return windows.groupBy(method).agg(
        F.count("*").alias("windows"), F.sum(F.when(F.col(response) <= 0, 1).otherwise(0)).alias("nonpositive"),
        F.avg(mass).alias("mean_mass"),
    )


def ranks_table(df: DataFrame, record: str, truth: str, candidates: str) -> DataFrame:
    return df.select(F.col(record).alias("record_id"), rank_of(truth, candidates).alias("rank"))


