"""Swap removed rows back in, keeping rows per cell and tokens unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.keys import seeded
from winnow.plans.cut import cut
from winnow.plans.ordered import top_per_group, with_row_number, with_running

#: Of a decided swap: what the next round and the result need.
SWAPPED = ["o", "id_in", "score", "cost", "grp", "free", "id_out", "score_out", "cost_out", "grp_out"]
FIRST = 1000  # arriving rows looked at besides four for every swap
SORTED = 10_000  # arriving rows that an ordered limit may find
SWAP = "id_in bigint, id_out bigint, gain double, token_delta bigint, score_in double"


def _pairs(pool: DataFrame, keys: list[str], into: Column, out: Column, most: int) -> DataFrame:
    """The r-th incoming row of a group meets its r-th outgoing row.

    Both sides are ranked in one pass over the pool; what is left of it is at most `most` rows per
    group and side.
    """
    rows = pool.select("id", "score", "cost", "cell", "selected", F.when(F.col("selected"), out).otherwise(into).alias("_o"))
    ranked = top_per_group(rows, [*keys, "selected"], [F.col("_o"), F.col("id")], most, "_r")
    one = F.struct("id", "score", "cost", "_o")
    met = ranked.groupBy(*keys, "_r").agg(
        F.max(F.when(~F.col("selected"), one)).alias("i"), F.max(F.when(F.col("selected"), one)).alias("o")
    )
    return met.filter("i is not null and o is not null").select(
        F.col("i.id").alias("id_in"), F.col("o.id").alias("id_out"), (F.col("i.score") - F.col("o.score")).alias("gain"),
        (F.col("i.cost") - F.col("o.cost")).cast("bigint").alias("token_delta"), F.col("i.score").alias("score_in"),
        F.col("i._o").alias("_o"),
    )


def refill(
    pool: DataFrame, max_swaps: int = 500, protected: Sequence[str] = (), exact_token_match: bool = True, cap: int | None = None
) -> DataFrame:
    """(id_in, id_out, gain, token_delta, score_in): the best swaps inside each cell (and cost).

    pool: (id, score, cost, cell, grp, selected). Ranking both sides and pairing equal ranks gives
    the same swaps as taking incoming rows one by one against the worst selected row left.
    """
    rows = pool.filter(~F.col("cell").isin(list(protected)) | F.col("selected")) if protected else pool
    keys = ["cell", "cost"] if exact_token_match else ["cell"]
    if max_swaps < 1:
        return pool.sparkSession.createDataFrame([], SWAP)
    if cap is None:
        pairs = _pairs(rows, keys, -F.col("score"), F.col("score"), max_swaps)
        return pairs.filter("gain > 0").drop("_o").orderBy(F.col("score_in").desc(), "id_in").limit(max_swaps)
    return _capped(rows, keys, max_swaps, cap)


def _capped(pool: DataFrame, keys: list[str], max_swaps: int, cap: int) -> DataFrame:
    """The sequential rule with a provenance cap, by rounds of proposals of all arriving rows at once.

    The rule, one arriving row after another in score order: a row whose group has room takes the worst selected row of its
    keys that is left, a row whose group is exactly full the worst one of its own group, any other none; it swaps if it scores
    higher. What a row may do depends on the decisions of earlier rows only.

    A round takes the decisions of the round before and lets every row decide again: how many rows its group has by then,
    how many swaps its keys have seen, which rows they took. If all decisions before a row were right, its new one is
    right too, whatever later rows had decided; so each round makes at least one more row right, and decisions that two
    rounds in a row agree on, from the first row up to some row, are those of the rule. Rounds end when that holds for all
    rows, or for `max_swaps` swaps. Rows count only up to a place in the order that is doubled while swaps are missing, and of the selected
    rows only those that they may take.

    Everything is a table; keys and groups of any size are cut into slices.
    """
    spark = pool.sparkSession
    pool = cut(pool.select("id", "score", "cost", "cell", "grp", "selected"))
    chosen = pool.filter("selected").drop("selected")
    # Arriving rows that beat no selected row of their keys can never swap.
    least = chosen.groupBy(*keys).agg(F.min("score").alias("_least"))
    arriving = pool.filter(~F.col("selected")).join(least, keys).filter(F.col("score") > F.col("_least")).drop("_least", "selected")
    arriving = arriving.withColumnRenamed("id", "id_in")
    total = arriving.count()
    upto = min(total, 4 * max_swaps + FIRST)
    rows = _first(arriving, chosen, upto)
    outs = _in_reach(chosen, rows, keys)
    made = cut(_decide(rows, outs, None, keys, cap))
    while True:
        new = cut(_decide(rows, outs, made, keys, cap))
        # the first row on which the two rounds differ; all decisions before it are final
        both = made.select("o", F.col("id_out").alias("was")).join(new.select("o", F.col("id_out").alias("now")), "o", "full")
        wrong = both.filter(~F.col("was").eqNullSafe(F.col("now"))).agg(F.min("o").alias("o")).first()["o"]
        made = new
        final = made if wrong is None else made.filter(F.col("o") < wrong)
        if wrong is None or final.count() >= max_swaps:
            if upto >= total or final.count() >= max_swaps:
                break
            upto = min(total, 2 * upto)
            rows = _first(arriving, chosen, upto)
            outs = _in_reach(chosen, rows, keys)
    swaps = final.orderBy("o").limit(max_swaps).select(
        "id_in", "id_out", (F.col("score") - F.col("score_out")).alias("gain"), (F.col("cost") - F.col("cost_out")).cast("bigint").alias("token_delta"),
        F.col("score").alias("score_in"))
    return spark.createDataFrame(swaps.collect(), SWAP)  # at most max_swaps rows


def _first(arriving: DataFrame, chosen: DataFrame, upto: int) -> DataFrame:
    """The first `upto` arriving rows with their place o and how many selected rows their group has.

    Few of them are found by an ordered limit, which sends at most so many rows a task; more are numbered in slices. Rows that agree
    in score and id come in the order of their other columns, so that a longer prefix begins with the shorter one.
    """
    order = [F.col("score").desc(), *[F.col(c) for c in ("id_in", "cost", "cell", "grp")]]
    if upto <= SORTED:
        rows = arriving.orderBy(*order).limit(upto).withColumn("o", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        rows = with_row_number(arriving, [], order, "o").filter(F.col("o") <= upto)
    rows = cut(rows)
    held = chosen.join(rows.select("grp").distinct(), "grp", "left_semi").groupBy("grp").agg(F.count("*").alias("held"))
    return cut(rows.join(held, "grp", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("bigint"))))


def _in_reach(chosen: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The selected rows that the arriving `rows` may take, numbered by score and id: slot in their keys, own in their keys and group.

    c rows of the same keys make at most c swaps. So a free taker finds its row among the first c + 1 of its keys, and a bound one among
    those of its group; no other selected row plays a part. Numbers are exact for the first c + 1 of all keys and for the groups of `rows`.
    """
    asked = rows.groupBy(*keys).agg((F.count("*") + 1).alias("_reach"))
    most = asked.agg(F.max("_reach").alias("m")).first()["m"] or 1
    order = [F.col("score"), F.col("id")]
    at = F.struct("score", "id")
    near = top_per_group(chosen.select(*keys, "score", "id").join(asked, keys), keys, order, most, "_r").filter(F.col("_r") <= F.col("_reach"))
    edge = cut(near.groupBy(*keys).agg(F.max(at).alias("_edge")))
    groups = rows.select(*keys, "grp").distinct().withColumn("_own", F.lit(True))
    found = chosen.join(edge, keys).join(groups, [*keys, "grp"], "left").filter((at <= F.col("_edge")) | F.col("_own")).drop("_edge", "_own")
    outs = cut(with_row_number(cut(found), keys, order, "slot"))
    return cut(with_row_number(outs, [*keys, "grp"], [F.col("slot")], "own"))


def _outgoing() -> list[Column]:
    return [F.col(c).alias(f"{c}_out") for c in ("id", "score", "cost", "grp")]


def _decide(rows: DataFrame, outs: DataFrame, made: DataFrame | None, keys: list[str], cap: int) -> DataFrame:
    """The swaps that all rows decide on, given the swaps of the round before (none: every row's group has room).

    Of the rows of its keys, those that free takers took are the first ones, but for rows that takers bound to their group took; so the
    worst row left is the n-th of the others, n counting the free swaps before, or an earlier one that a bound taker takes only
    later. The same holds inside a group with the roles exchanged.
    """
    inside = [*keys, "grp"]
    if made is None:
        asks = with_row_number(rows, keys, [F.col("o")], "n").withColumn("free", F.lit(True)).withColumn("place", F.col("n"))
        met = asks.join(outs.select(*keys, F.col("slot").alias("place"), *_outgoing()), [*keys, "place"])
    else:
        # who took a row first
        took = made.groupBy("id_out").agg(F.min(F.struct("o", "free")).alias("t")).select("id_out", F.col("t.o").alias("t"), F.col("t.free").alias("by_free"))
        state = cut(outs.join(took.withColumnRenamed("id_out", "id"), "id", "left"))
        bound, freed = F.coalesce(~F.col("by_free"), F.lit(False)), F.coalesce("by_free", F.lit(False))

        moves = made.select(F.explode(F.array(
            F.struct(F.col("grp").alias("grp"), F.lit(1).alias("kind"), F.lit(1).alias("d")),
            F.struct(F.col("grp_out").alias("grp"), F.lit(2).alias("kind"), F.lit(-1).alias("d")))).alias("m"), "o").select("m.*", "o")
        seen = rows.select("grp", F.lit(0).alias("kind"), F.lit(0).alias("d"), "o").unionByName(moves)
        seen = with_running(seen, ["grp"], [F.col("o"), F.col("kind")], "d", "moved", "sum").filter("kind = 0").select("o", "moved")

        def before(names: list[str], free: bool, taken: DataFrame, place: str) -> DataFrame:
            """(o, n, later) for every row: swaps of one kind before it in its names, and the least place that the other kind takes at or after it."""
            swaps = made.filter(F.col("free") == free).select(*names, "o", F.lit(1).alias("kind"), F.lit(1).alias("d"))
            asks = rows.select(*names, "o", F.lit(0).alias("kind"), F.lit(0).alias("d"))
            n = with_running(asks.unionByName(swaps), names, [F.col("o"), F.col("kind")], "d", "n", "sum").filter("kind = 0").select("o", "n")
            places = taken.select(*names, F.col("t").alias("o"), F.lit(0).alias("kind"), F.col(place).alias("p"))
            asks = rows.select(*names, "o", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("p"))
            later = with_running(places.unionByName(asks), names, [F.col("o").desc(), F.col("kind"), F.col("p")], "p", "later", "min").filter("kind = 1").select("o", "later")
            return n.join(later, "o")

        now = F.col("held") + F.col("moved")
        asks = cut(rows.join(seen, "o").withColumn("free", F.when(now < cap, True).when(now == cap, False)).filter("free is not null"))
        left = with_row_number(state.filter(~bound).select(*keys, "slot"), keys, [F.col("slot")], "n").withColumn("n", F.col("n") - 1)
        a = asks.filter("free").join(before(keys, True, state.filter(bound), "slot"), "o").join(left, [*keys, "n"], "left")
        a = a.withColumn("place", F.least("slot", "later")).select(*rows.columns, "free", "place")
        met = a.join(outs.select(*keys, F.col("slot").alias("place"), *_outgoing()), [*keys, "place"])
        left = with_row_number(state.filter(~freed).select(*inside, "own"), inside, [F.col("own")], "n").withColumn("n", F.col("n") - 1)
        b = asks.filter("not free").join(before(inside, False, state.filter(freed), "own"), "o").join(left, [*inside, "n"], "left")
        b = b.withColumn("place", F.least("own", "later")).select(*rows.columns, "free", "place")
        names = list(dict.fromkeys([*SWAPPED, *keys]))
        met = met.select(*names).unionByName(b.join(outs.select(*inside, F.col("own").alias("place"), *_outgoing()), [*inside, "place"]).select(*names))
    names = list(dict.fromkeys([*SWAPPED, *keys]))
    return met.filter(F.col("score") > F.col("score_out")).select(*names)


def random_refill(pool: DataFrame, max_swaps: int, seed: int, exact_token_match: bool = True) -> DataFrame:
    """Random rows in and out of the same cell and cost, without a score condition."""
    keys = ["cell", "cost"] if exact_token_match else ["cell"]
    pairs = _pairs(pool, keys, seeded(f"{seed}-in", "id"), seeded(f"{seed}-out", "id"), max_swaps)
    return pairs.orderBy("_o").limit(max_swaps).drop("_o")


def apply_swaps(pool: DataFrame, swaps: DataFrame) -> DataFrame:
    """The pool with its selected flag after the swaps."""
    moved = swaps.select(F.explode(F.array(
        F.struct(F.col("id_in").alias("id"), F.lit(True).alias("_now")), F.struct(F.col("id_out").alias("id"), F.lit(False).alias("_now"))
    )).alias("m")).select("m.*")
    return pool.join(moved, "id", "left").withColumn("selected", F.coalesce("_now", "selected")).drop("_now")
