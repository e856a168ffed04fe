"""Random walks on edge tables and exploration mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.contracts import require_clean
from winnow.plans.cut import cut
from winnow.plans.ordered import with_group

STEPS = 5


def personalized_pagerank(
    edges: DataFrame, restart: DataFrame, alpha: float = 0.85, tol: float = 1e-9, max_iter: int = 1000
) -> DataFrame:
    """(node, rank). edges: (src, dst, w); restart: (node, p) over every node.

    The mass of nodes without outgoing weight goes to the restart vector. That only scales the
    restart term, so the walk x = alpha P'x + p without it is solved and normalised at the end; no
    step needs a global sum. Several steps are one job and the vector is written down after each.
    """
    if not 0 <= alpha < 1:
        raise ValueError("invalid damping")
    require_clean(edges.filter("w < 0").select("src", "dst", "w"), "negative edge")
    nodes = cut(restart.selectExpr("node as dst", "cast(p as double) as p"))
    positive = edges.filter("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = positive.groupBy("src").agg(F.sum("w").alias("_t"))
    steps = cut(positive.join(out, "src").selectExpr("src", "dst", f"{float(alpha)!r}D * w / _t as share"))
    start = cut(nodes.selectExpr("dst as src", "p as x"))
    # Shares are summed map-side by destination, so a hub is never one task's list of edges.
    inflow = F.expr("sum(x * share)").alias("inflow")
    for _ in range(0, max_iter, STEPS):
        x = start
        for _ in range(STEPS):
            moved = steps.join(x, "src").groupBy("dst").agg(inflow)
            x = nodes.join(moved, "dst", "left").selectExpr("dst as src", "coalesce(inflow, 0D) + p as x")
        both = cut(x.join(start.selectExpr("src", "x as old"), "src"))
        row = both.selectExpr("abs(x - old) as d", "x").agg(F.sum("d").alias("d"), F.sum("x").alias("s")).first()
        start = both.select("src", "x")
        if row["d"] < tol * row["s"]:
            return start.select(F.col("src").alias("node"), (F.col("x") / F.lit(row["s"])).alias("rank"))
    raise RuntimeError("random walk did not converge")


def absorbing_value(
    transitions: DataFrame, rewards: DataFrame, discount: float = 1.0, tol: float = 1e-10, max_iter: int = 2000
) -> DataFrame:
    """(state, value) of (I - discount Q)^-1 r. transitions: (src, dst, p); rewards: (state, r).

    Repeated value steps converge exactly when the walk is absorbed or discounted; when the change
    stops shrinking at the limit the system is reported as not absorbing.
    """
    over = transitions.groupBy("src").agg(F.sum("p").alias("m")).filter(f"m > {1 + 1e-10}")
    require_clean(over, "rows of a substochastic matrix sum to more than one")
    reward = cut(rewards.selectExpr("state as src", "cast(r as double) as r"))
    moves = cut(transitions.selectExpr("src", "dst", f"p * {float(discount)!r}D as p"))
    start = cut(reward.selectExpr("src as dst", "r as value"))
    ahead = F.expr("sum(p * value)").alias("ahead")
    for _ in range(0, max_iter, STEPS):
        value = start
        for _ in range(STEPS):
            moved = moves.join(value, "dst").groupBy("src").agg(ahead)
            value = reward.join(moved, "src", "left").selectExpr("src as dst", "r + coalesce(ahead, 0D) as value")
        both = cut(value.join(start.selectExpr("dst", "value as old"), "dst"))
        row = both.selectExpr("abs(value - old) as d", "abs(value) as v").agg(F.max("d").alias("d"), F.max("v").alias("v")).first()
        start = both.select("dst", "value")
        if row["d"] <= tol * (1 + row["v"]):
            return start.select(F.col("dst").alias("state"), "value")
    raise ValueError("dynamics are not absorbing")


def safe_mixture(df: DataFrame, group: Sequence[str], base: str, explore: str, lower: str, minimum: float, most: float = 1.0) -> DataFrame:
    """Add epsilon and q: the largest exploration share that keeps the expected lower reward at the minimum."""
    rows = with_group(
        df, list(group), F.sum(F.col(base) * F.col(lower)).alias("_b"), F.sum(F.col(explore) * F.col(lower)).alias("_e")
    )
    falling = F.col("_e") < F.col("_b")
    limit = F.greatest(F.lit(0.0), (F.col("_b") - F.lit(minimum)) / F.when(falling, F.col("_b") - F.col("_e")))
    eps = F.when(falling, F.least(F.lit(float(most)), limit)).otherwise(F.lit(float(most)))
    # A base that already misses the floor has no safe share.
    eps = F.when(F.col("_b") >= minimum - 1e-12, eps)
    return rows.withColumn("epsilon", eps).withColumn(
        "q", (1 - F.col("epsilon")) * F.col(base) + F.col("epsilon") * F.col(explore)
    ).drop("_b", "_e")


def kl_tilt(df: DataFrame, group: Sequence[str], p: str, utility: str, temperature: float = 1.0, out: str = "q") -> DataFrame:
    """Add out proportional to p * exp(utility / temperature) on the support of p."""
    if temperature <= 0:
        raise ValueError(f"temperature must be above 0, not {temperature}")
    on = F.col(p) > 0
    z = F.when(on, F.log(F.when(on, F.col(p))) + F.col(utility) / F.lit(float(temperature)))
    # each written table is read twice, by the aggregate and by the join; nothing above is computed again
    rows = with_group(cut(df.withColumn("_z", z)), list(group), F.max("_z").alias("_top"))
    rows = cut(rows.withColumn("_w", F.coalesce(F.exp(F.col("_z") - F.col("_top")), F.lit(0.0))))
    rows = with_group(rows, list(group), F.sum("_w").alias("_s"))
    return rows.withColumn(out, F.col("_w") / F.col("_s")).drop("_z", "_top", "_w", "_s")


def coverage_new(df: DataFrame, seen: DataFrame, group: Sequence[str], item: str, p: str) -> DataFrame:
    """(group..., mass): probability on items not seen yet; a group with nothing new shows 0."""
    marked = df.join(seen.select(*group, item).distinct().withColumn("_seen", F.lit(True)), [*group, item], "left")
    return marked.groupBy(*group).agg(F.sum(F.when(F.col("_seen").isNull(), F.col(p)).otherwise(0.0)).alias("mass"))


def speculative_identity(target: DataFrame, draft: DataFrame, group: Sequence[str], item: str, p: str = "p") -> DataFrame:
    """(group..., item, output, acceptance): the law of draft, accept and residual, and the accepted mass."""
    t = target.select(*group, item, F.col(p).alias("_t"))
    d = draft.select(*group, item, F.col(p).alias("_d"))
    rows = t.join(d, [*group, item], "full_outer").na.fill(0.0, ["_t", "_d"])
    rows = rows.withColumn("_acc", F.least("_t", "_d")).withColumn("_res", F.greatest(F.col("_t") - F.col("_d"), F.lit(0.0)))
    rows = with_group(rows, list(group), F.sum("_acc").alias("acceptance"), F.sum("_res").alias("_r"))
    left = 1 - F.col("acceptance")
    extra = F.when(left < 1e-14, 0.0).otherwise(left * F.col("_res") / F.when(F.col("_r") > 0, F.col("_r")))
    return rows.select(*group, item, (F.col("_acc") + F.coalesce(extra, F.lit(0.0))).alias("output"), "acceptance")
