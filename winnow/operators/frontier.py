"""Responses and frontier weights: the pool is priced on Spark, a few columns are solved on the driver.

A response row has an array `a` with one signed value per objective; objectives are few, rows are
many. Every loop below makes one aggregate pass over the pool per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.vectors import dot, dot_sql, dot_with, norm, scaled, sum_array, sum_by
from winnow.plans.converge import require
from winnow.plans.cut import cut
from winnow.plans.partials import stack
from winnow.plans.smalllp import face, game, guarded


def response_matrix(df: DataFrame, v: str, targets: Sequence[Sequence[float]], scales: Sequence[float] | None = None, out: str = "a") -> DataFrame:
    """Add a: the dot product of each row's vector with every target, divided by the target's scale."""
    s = [1.0] * len(targets) if scales is None else [float(x) for x in scales]
    if any(x <= 0 for x in s):
        raise ValueError(f"scales must be above 0: {s}")
    return df.withColumn(out, F.array(*[dot_with(v, t) / F.lit(x) for t, x in zip(targets, s)]))


def response_with_floor(df: DataFrame, a: str, p: str, floor: float, m: int) -> DataFrame:
    """Replace a by floor * (A p) + (1 - floor) * a."""
    if not 0 <= floor <= 1:
        raise ValueError(f"floor must be from 0 to 1, not {floor}")
    mean = df.agg(sum_array(a, m, F.col(p)).alias("mean")).select("mean").scalar()
    mixed = F.zip_with(F.col(a), F.col("_mean"), lambda x, c: F.lit(floor) * c + F.lit(1 - floor) * x)
    return df.withColumn("_mean", mean).withColumn(a, mixed).drop("_mean")


def worst(a: str = "a") -> Column:
    return F.array_min(a)


def priced(a: str, witness: Sequence[float]) -> Column:
    return dot_with(a, witness)


def price_columns(df: DataFrame, id: str, a: str, witness: Sequence[float], margin: float, k: int) -> DataFrame:
    """The k rows with the largest reduced value witness.a - margin."""
    value = F.round(priced(a, witness) - F.lit(float(margin)), 12)
    return df.select(id, value.alias("reduced")).orderBy(F.col("reduced").desc(), id).limit(k)


def frontier_certificate(df: DataFrame, a: str, q: str, witness: Sequence[float], m: int, tol: float = 1e-7) -> DataFrame:
    """(low, up, gap, certified) of given weights and a given witness."""
    gains = [F.sum(F.col(q) * F.element_at(a, i + 1)) for i in range(m)]
    row = df.agg(F.array_min(F.array(*gains)).alias("low"), F.max(priced(a, witness)).alias("up"))
    gap = F.col("up") - F.col("low")
    return row.withColumn("gap", gap).withColumn("certified", (gap >= -tol) & (gap <= tol * (1 + F.abs("up"))))


@dataclass
class Frontier:
    weights: dict
    margin: float
    gains: list[float]
    witness: list[float]
    upper: float
    gap: float
    certified: bool
    rounds: int
    note: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)

    def pool(self, spark, id_type: str = "bigint") -> DataFrame:
        """(id, a) of all columns that were generated, to start from when the table has grown."""
        return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in self.columns.items()], f"id {id_type}, a array<double>")

    def frame(self, spark, id_type: str = "bigint") -> DataFrame:
        return spark.createDataFrame([(k, float(w)) for k, w in sorted(self.weights.items())], f"id {id_type}, q double")


def _best_rows(df: DataFrame, id: str, a: str, scores: list[Column]) -> dict:
    """The best row for each score, all in one aggregate."""
    picks = [F.max_by(F.struct(F.col(id).alias("id"), F.col(a).alias("a")), F.struct(s, F.col(id))).alias(f"s{i}") for i, s in enumerate(scores)]
    row = df.agg(*picks).first()
    return {r["id"]: np.asarray(r["a"], dtype=float) for r in row if r is not None}


def frontier_weights(
    df: DataFrame, id: str, a: str, m: int, tol: float = 1e-7, extra: dict | None = None, rounds: int = 1000, start: DataFrame | None = None
) -> Frontier:
    """Weights over all rows that maximize the worst objective, with a dual witness.

    The driver solves over the few columns generated so far; each pass prices every row with the
    witness and brings back the best one. An optimum needs at most m columns. `extra` adds
    columns that are not rows, such as the zero column of no update.

    `start` names rows to begin with, by their column `id`: rows nominated without responses, or the columns of an earlier solution
    (Frontier.pool), kept in a table and used again after the table has grown. Their responses are read from df, so
    rows that are gone do no harm and rows that have changed count as they are now. The caller bounds their number.
    """
    pool = cut(df.select(F.col(id).alias("id"), F.col(a).alias("a")))
    columns = dict(extra or {})
    if start is not None:
        columns.update({r["id"]: np.asarray(r["a"], dtype=float) for r in pool.join(start.select("id").distinct(), "id", "left_semi").collect()})
    seeds = [F.element_at("a", i + 1) for i in range(m)] + [worst("a"), priced("a", [1.0 / m] * m)]
    if not columns:
        columns.update(_best_rows(pool, "id", "a", seeds))
    if not columns:
        raise ValueError("no row to weigh: the table is empty")
    up, done, witness, q, margin = np.inf, 0, None, None, 0.0
    for done in range(1, rounds + 1):
        keys = list(columns)
        q, margin, witness = game(np.stack([columns[k] for k in keys], axis=1))
        best = _best_rows(pool, "id", "a", [priced("a", witness)])
        up = max([float(witness @ c) for c in [*best.values(), *columns.values()]])
        if up - margin <= tol * (1 + abs(margin)) or all(k in columns for k in best):
            break
        columns.update(best)
    gap = up - margin
    require(gap <= max(tol, 1e-8) * (1 + abs(up)), "frontier weights", gap, done)
    gains = np.stack([columns[k] for k in keys], axis=1) @ q
    weights = {k: float(w) for k, w in zip(keys, q) if w > 0}
    return Frontier(
        weights, margin, gains.tolist(), witness.tolist(), up, gap, bool(gap <= tol * (1 + abs(up))), done,
        columns={k: c for k, c in columns.items() if k not in (extra or {})},
    )


def robust_frontier(df: DataFrame, id: str, a: str, radius: str, m: int, tol: float = 1e-7) -> Frontier:
    """Frontier of the lower responses a - radius."""
    return frontier_weights(df.withColumn(a, F.zip_with(a, radius, lambda x, u: x - u)), id, a, m, tol)


def opportunity(df: DataFrame, id: str, a: str, m: int) -> dict:
    """Best single row, best mix and their gap, with no update as one more column."""
    single = df.agg(F.max(worst(a)).alias("w")).first()["w"]
    none = "no_update"
    solved = frontier_weights(df, id, a, m, extra={none: np.zeros(m)})
    best = max(0.0, float(single))
    return {
        "weights": {k: w for k, w in solved.weights.items() if k != none},
        "no_update_mass": solved.weights.get(none, 0.0), "single_margin": best, "mixed_margin": solved.margin,
        "gap": solved.margin - best, "solver_gap": solved.gap,
    }


def dual_face_gain(old: DataFrame, new: DataFrame, id: str, a: str, m: int, tol: float = 1e-9, rounds: int = 1000) -> dict:
    """How much the new pool can raise the old margin, over the whole optimal dual face.

    Cutting planes on the witness: each round finds the old row that most violates the face and
    the new row that most raises the value, one aggregate each.
    """
    solved = frontier_weights(old, id, a, m, tol=1e-9)
    olds = cut(old.select(F.col(id).alias("id"), F.col(a).alias("a")))
    news = cut(new.select(F.col(id).alias("id"), F.col(a).alias("a")))
    bound = solved.upper + tol
    axes = [F.element_at("a", i + 1) for i in range(m)]
    a_cuts = _best_rows(olds, "id", "a", [*axes, priced("a", solved.witness)])
    b_cuts = _best_rows(news, "id", "a", [*axes, priced("a", solved.witness)])
    value, witness, closed = 0.0, np.asarray(solved.witness), False
    for _ in range(rounds):
        value, witness = face(np.stack(list(a_cuts.values()), axis=1), np.stack(list(b_cuts.values()), axis=1), bound)
        over = _best_rows(olds, "id", "a", [priced("a", witness)])
        rise = _best_rows(news, "id", "a", [priced("a", witness)])
        bad_a = {k: v for k, v in over.items() if float(witness @ v) > bound + 1e-12 and k not in a_cuts}
        bad_b = {k: v for k, v in rise.items() if float(witness @ v) > value + 1e-10 and k not in b_cuts}
        if not bad_a and not bad_b:
            closed = True
            break
        a_cuts.update(bad_a)
        b_cuts.update(bad_b)
    require(closed, "dual face", np.inf, rounds)
    gain = value - solved.margin
    return {"gain": float(gain), "witness": witness.tolist(), "positive": gain > max(10 * tol, 1e-7), "old_margin": solved.margin}


# ---- box-bounded weights -----------------------------------------------------------------------


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 1024) -> tuple[float, int, int]:
    """(x, above, equal): the k-th largest value, rows strictly above it and rows equal to it.

    Counting in bins narrows the range until the bin of the k-th row holds at most `bins` rows or one
    value, so no sort and no gathering of rows is needed however many rows share a value.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).first()
    lo, hi, above, inside = ends["lo"], ends["hi"], 0, ends["n"]
    if not 1 <= k <= inside:
        raise ValueError(f"the table has no {k}-th row")
    while lo < hi and inside > bins:
        width = (hi - lo) / bins
        slot = f"least(greatest(floor(({value} - {lo!r}D) / {width!r}D), 0), {bins - 1})" if width > 0 else "0"
        rows = (
            df.filter(f"{value} >= {lo!r}D and {value} <= {hi!r}D").groupBy(F.expr(slot).alias("b"))
            .agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        )
        for row in sorted(rows, key=lambda r: -r["lo"]):
            if above + row["n"] >= k:
                lo, hi, inside = row["lo"], row["hi"], row["n"]
                break
            above += row["n"]
    if lo == hi:
        return float(lo), int(above), int(inside)
    few = df.filter(f"{value} >= {lo!r}D and {value} <= {hi!r}D").groupBy(value).agg(F.count("*").alias("n")).collect()
    for row in sorted(few, key=lambda r: -r[value]):
        if above + row["n"] >= k:
            return float(row[value]), int(above), int(row["n"])
        above += row["n"]
    raise ArithmeticError("rows changed between passes")


@dataclass
class Fill:
    """One extreme weighting: the largest scores at the cap, one shared level at the threshold."""

    witness: list[float]
    threshold: float
    high: float
    at: float
    low: float

    def sql(self, a: str) -> str:
        if np.isinf(self.threshold):
            return f"{self.high!r}D"
        s = f"round({dot_sql(a, self.witness)}, 12)"
        return f"case when {s} > {self.threshold!r}D then {self.high!r}D when {s} = {self.threshold!r}D then {self.at!r}D else {self.low!r}D end"


def fill(pool: DataFrame, a: str, witness: Sequence[float], n: int, low: float, high: float, m: int) -> tuple[Fill, np.ndarray]:
    """The weighting in the box [low, high] that maximizes witness.(A q), and its A q."""
    witness = [float(x) for x in witness]
    left = 1.0 - n * low
    room = high - low
    full = n if room <= 0 else min(n, int(np.floor(left / room + 1e-9)))
    if full >= n:
        one = Fill(witness, -np.inf, high, high, low)
    else:
        scores = pool.selectExpr(f"round({dot_sql(a, witness)}, 12) as s")
        x, above, equal = kth_largest(scores, "s", full + 1)
        one = Fill(witness, x, high, float(low + (left - above * room) / equal), low)
    total = pool.selectExpr("a", f"{one.sql(a)} as w").agg(F.array(*[F.expr(f"sum(w * a[{i}])") for i in range(m)]).alias("g")).first()
    return one, np.asarray(total["g"])


def mixed_fills(fills: list[Fill], weights: Sequence[float], a: str) -> Column:
    """The weights of a mix of fills, as a column over the pool."""
    return F.expr(" + ".join(f"{float(w)!r}D * ({f.sql(a)})" for f, w in zip(fills, weights) if w > 0))


def _box(n: int, multiple: float, floor: float) -> tuple[float, float]:
    if multiple < 1 or not 0 <= floor <= 1:
        raise ValueError("invalid weight cap")
    return floor / n, min(1.0, multiple / n)


def capped_frontier(
    df: DataFrame, id: str, a: str, m: int, multiple: float = 2.0, floor: float = 0.0, tol: float = 1e-7, rounds: int = 400
) -> tuple[DataFrame, dict]:
    """Max-min weights with floor/n <= q <= multiple/n: (id, q) and margin, witness and gap.

    For a fixed witness the best weighting fills the largest scores to the cap. The driver mixes
    the fills met so far and returns the next witness; a witness whose own fill is no better than the
    mix closes the gap.
    """
    pool = cut(df.select(F.col(id).alias("id"), F.col(a).alias("a")))
    n = pool.count()
    low, high = _box(n, multiple, floor)
    fills, gains = [], []
    witness = np.ones(m) / m
    weights, margin, upper = np.ones(1), -np.inf, np.inf
    for _ in range(rounds):
        one, gain = fill(pool, "a", witness, n, low, high, m)
        upper = min(upper, float(witness @ gain))
        fills.append(one)
        gains.append(gain)
        weights, margin, witness = game(np.stack(gains, axis=1))
        if upper - margin <= tol * (1 + abs(upper)):
            break
    require(upper - margin <= tol * (1 + abs(upper)), "capped weights", upper - margin, rounds)
    q = pool.select("id", mixed_fills(fills, weights, "a").alias("q"))
    info = {"margin": margin, "upper": upper, "gap": upper - margin, "witness": witness.tolist(), "fills": len(fills),
            "certified": bool(upper - margin <= tol * (1 + abs(upper)))}
    return q, info


def guarded_weights(
    df: DataFrame, id: str, a: str, m: int, primary: Sequence[float], guardrails: dict[int, float],
    multiple: float = 2.0, floor: float = 0.0, rounds: int = 400,
) -> tuple[DataFrame, dict]:
    """Maximize a primary combination with (A q)_r >= threshold for guarded rows and a weight box.

    Infeasible guardrails raise.
    """
    p = np.asarray(primary, dtype=float)
    if p.shape != (m,) or (p < 0).any() or p.sum() <= 0:
        raise ValueError("primary weights must be nonnegative and nonzero")
    p = p / p.sum()
    rows = sorted(guardrails)
    if any(not 0 <= r < m for r in rows):
        raise ValueError("the guard must name an objective and a lowest value")
    limits = np.asarray([guardrails[r] for r in rows], dtype=float)
    pool = cut(df.select(F.col(id).alias("id"), F.col(a).alias("a")))
    n = pool.count()
    low, high = _box(n, multiple, floor)
    fills, gains, weights, feasible, direction, closed = [], [], np.ones(1), not rows, p, False
    gap = np.inf
    for _ in range(rounds):
        one, gain = fill(pool, "a", direction, n, low, high, m)
        if gains:
            stacked = np.stack(gains, axis=1)
            value = float(direction @ gain)
            reached = float(max(direction @ stacked[:, k] for k in range(stacked.shape[1])))
            gap = value - reached
            if gap <= 1e-10 * (1 + abs(value)):
                closed = True
                break
        fills.append(one)
        gains.append(gain)
        stacked = np.stack(gains, axis=1)
        weights, mult, feasible = guarded(p @ stacked, stacked[rows] - limits[:, None]) if rows else (
            np.eye(len(gains))[int(np.argmax(p @ stacked))], np.zeros(0), True)
        lift = np.zeros(m)
        lift[rows] = mult
        direction = (p if feasible else np.zeros(m)) + lift
    require(closed, "guarded weights", gap, rounds)
    if not feasible:
        raise ValueError("guarded weights are infeasible")
    q = pool.select("id", mixed_fills(fills, weights, "a").alias("q"))
    reached = np.stack(gains[: len(weights)], axis=1) @ weights
    slack = 1e-8 * (1 + np.abs(reached).max())
    if any(reached[r] < t - slack for r, t in zip(rows, limits)):
        raise ArithmeticError("guarded weights failed the feasibility check")
    return q, {"primary": float(p @ reached), "responses": reached.tolist(), "fills": len(fills)}


# ---- intervals, bounds and pairs -----------------------------------------------------------------


def clipped(v: str, clip: float) -> Column:
    n = norm(v)
    return scaled(v, F.when(n > clip, F.lit(clip) / F.when(n > clip, n)).otherwise(F.lit(1.0)))


def response_interval(
    targets: DataFrame, objective: str, v: str, updates: DataFrame, id: str, g: str, clip: float, delta: float = 0.05
) -> DataFrame:
    """(id, objective, mean, radius): clipped-mean responses with a simultaneous Hoeffding radius."""
    if clip <= 0 or not 0 < delta < 1:
        raise ValueError("clip must be above 0 and delta between 0 and 1")
    means = sorted(sum_by(targets.withColumn("_c", clipped(v, clip)), [objective], "_c").collect(), key=lambda r: r[objective])
    pool = updates.count()
    factor = np.log(2.0 * len(means) * pool / delta)
    parts = [
        F.struct(
            F.lit(row[objective]).alias("objective"),
            dot_with(g, np.asarray(row["s"]) / row["w"]).alias("mean"),
            (F.lit(float(clip * np.sqrt(2.0 * factor / row["w"]))) * norm(g)).alias("radius"),
        )
        for row in means
    ]
    return updates.select(F.col(id).alias("id"), F.explode(F.array(*parts)).alias("r")).select("id", "r.*")


def descent_bound(
    pool: DataFrame, g: str, q: str, targets: Sequence[Sequence[float]], step: float, smoothness: float,
    gradient_error: float = 0.0, direction_error: float = 0.0, batch: int | None = None,
) -> DataFrame:
    """Per objective the smoothness lower bound of the loss decrease along the mean direction."""
    if step < 0 or smoothness < 0 or gradient_error < 0 or direction_error < 0 or (batch is not None and batch < 1):
        raise ValueError("smoothness and the error bounds must not be negative")
    w = F.col(q)
    d = np.asarray(sum_by(pool, [], g, w).first()["s"], dtype=float)
    n = float(np.linalg.norm(d))
    trace = 0.0
    if batch is not None:
        trace = max(pool.agg(F.sum(w * dot(g, g)).alias("sq")).first()["sq"] - n * n, 0.0)
    out = []
    for i, target in enumerate(targets):
        v = np.asarray(target, dtype=float)
        first = float(v @ d) - gradient_error * n - (float(np.linalg.norm(v)) + gradient_error) * direction_error
        bound = step * first - 0.5 * smoothness * step**2 * (n + direction_error) ** 2
        if batch is not None:
            bound -= 0.5 * smoothness * step**2 * trace / batch
        out.append((i, float(bound)))
    return pool.sparkSession.createDataFrame(out, "objective int, bound double")


CELLS = 512  # cells whose pairs the driver bounds at the start
PAIRS = 200_000  # pairs of units evaluated without a further split, besides 16 for every unit


def best_pair(units: DataFrame, id: str, a: str, m: int, tol: float = 1e-9) -> DataFrame:
    """The two units whose best mix gains most, preferring pairs where both singles fail and the mix succeeds.

    (left, right, fraction, margin, gain, strict). Units fall into the cells of a grid over their responses. The best mix of two
    cells' upper corners bounds every pair of their units, and pairs of cells whose bound stays below a pair already seen are
    dropped; the others split by an equality join of each cell with its halves, until few pairs of units are left,
    which are evaluated. Equal responses count once, with their smallest ids.
    """
    rows = units.select(F.col(id).cast("bigint").alias("id"), F.col(a).cast("array<double>").alias("a"))
    classes = cut(rows.groupBy("a").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("id").alias("top")))
    found = _pair_search(classes.filter(F.array_min("a") <= tol), m, tol, strict=True)
    if found is None:
        found = _pair_search(classes, m, tol, strict=False)
        # Two units of equal responses: any mix of them is each of them.
        same = rows.join(classes.filter("n > 1").select("a", F.col("id").alias("first")), "a").filter("id > first")
        worst_ = F.array_min("a")
        twin = same.select("first", "id", worst_.alias("w"), F.least(worst_, F.lit(0.0)).alias("g")).agg(
            F.max_by(F.struct("first", "id", "w", "g"), F.struct(F.round("g", 12), F.round("w", 12), -F.col("first"), -F.col("id"))).alias("t")).first()["t"]
        if twin is not None:
            other = (twin["first"], twin["id"], 0.0, twin["w"], twin["g"], False)
            found = other if found is None else max(found, other, key=_pair_key)
    schema = "left bigint, right bigint, fraction double, margin double, gain double, strict boolean"
    return units.sparkSession.createDataFrame([found] if found else [], schema)


_PAIR = ["left", "right", "fraction", "margin", "gain", "strict"]


def _pair_key(row: tuple) -> tuple:
    left, right, _, margin, gain, strict = row
    return strict, round(gain, 12), round(margin, 12), -left, -right


def _mix(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fraction of right, worst objective) of the best mix of every row of left with the same row of right."""
    slope = right - left
    fractions = [np.zeros(len(left)), np.ones(len(left))]
    m = left.shape[1]
    for i in range(m):
        for j in range(i + 1, m):
            bottom = slope[:, i] - slope[:, j]
            ok = np.abs(bottom) > 1e-14
            f = np.where(ok, (left[:, j] - left[:, i]) / np.where(ok, bottom, 1.0), 0.0)
            fractions.append(np.where((f >= 0) & (f <= 1), f, 0.0))
    f = np.stack(fractions)
    value = (left[None] + f[:, :, None] * slope[None]).min(2)
    pick = value.argmax(0)
    at = np.arange(len(left))
    return f[pick, at], value[pick, at]


def _gains(left: np.ndarray, right: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fraction, margin, gain over the best single); low and high replace the singles, for bounds."""
    fraction, margin = _mix(left, right)
    single = np.maximum(left.min(1) if low is None else low, right.min(1) if high is None else high)
    return fraction, margin, margin - np.maximum(single, 0.0)


def _pair_search(classes: DataFrame, m: int, tol: float, strict: bool) -> tuple | None:
    """The best pair of different classes; with strict only pairs whose mix succeeds."""
    import pandas as pd

    spark = classes.sparkSession
    ends = classes.agg(F.count("*").alias("n"), *(f(F.element_at("a", i + 1)).alias(f"{n}{i}") for i in range(m) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends["n"] < 2:
        return None
    low = [ends[f"lo{i}"] for i in range(m)]
    wide = [max(ends[f"hi{i}"] - ends[f"lo{i}"], 1e-300) for i in range(m)]

    def code(level: int) -> Column:
        """The cell of a row: every objective's range in 2^level parts; a cell of the level before holds the cells of half its numbers."""
        at = [F.least(F.floor((F.element_at("a", i + 1) - F.lit(low[i])) / F.lit(wide[i]) * F.lit(float(1 << level))), F.lit((1 << level) - 1)) for i in range(m)]
        return F.array(*at)

    def cells(level: int) -> DataFrame:
        high = F.array(*[F.max(F.element_at("a", i + 1)) for i in range(m)])
        return classes.groupBy(code(level).alias("cell")).agg(
            high.alias("high"), F.min(F.array_min("a")).alias("least"), F.count("*").alias("n"),
            F.max_by(F.struct("id", "a"), F.struct(F.array_min("a"), -F.col("id"))).alias("one"))

    best: list = [None]

    def offer(rows: list[tuple]) -> None:
        for row in rows:
            left, right, _, margin, _, _ = row
            if (not strict or margin > tol) and (best[0] is None or _pair_key(row) > _pair_key(best[0])):
                best[0] = row

    def enough(margin: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Which bounds leave room for a pair as good as the best one seen."""
        out = margin > tol if strict else np.ones(len(gain), bool)
        return out if best[0] is None else out & (gain >= best[0][4] - 1e-11)

    def pairs_of(x: pd.DataFrame, y: pd.DataFrame) -> list[tuple]:
        """Evaluated pairs of classes, row by row, the smaller id left; the best only."""
        one, two = x["id"].to_numpy(), y["id"].to_numpy()
        a, b = stack(x["a"]), stack(y["a"])
        swap = one > two
        left, right = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        fraction, margin, gain = _gains(left, right)
        good = (left.min(1) <= tol) & (right.min(1) <= tol) & (margin > tol)
        keep = np.flatnonzero((one != two) & (good | (not strict)))
        if not len(keep):
            return []
        first, second = np.minimum(one, two)[keep], np.maximum(one, two)[keep]
        k = np.lexsort((second, first, -np.round(margin[keep], 12), -np.round(gain[keep], 12), ~good[keep]))[0]
        i = keep[k]
        return [(int(first[k]), int(second[k]), float(fraction[i]), float(margin[i]), float(gain[i]), bool(good[i]))]

    # the finest level whose cells are few: their pairs are bounded here
    counts = classes.agg(*(F.approx_count_distinct(code(level)).alias(str(level)) for level in range(1, 11))).first()
    level = max([n for n in range(1, 11) if counts[str(n)] <= CELLS // 2], default=0)
    top = cells(level).orderBy("cell").toPandas()  # about CELLS / 2 of them
    high, least, number = stack(top["high"]), top["least"].to_numpy(), top["n"].to_numpy()
    u, v = np.triu_indices(len(top))
    singles = top["one"].apply(lambda r: r["id"]), top["one"].apply(lambda r: r["a"])
    ones = pd.DataFrame({"id": singles[0].to_numpy(), "a": list(singles[1])})
    offer(pairs_of(ones.iloc[u], ones.iloc[v]))
    _, margin, gain = _gains(high[u], high[v], least[u], least[v])
    keep = np.flatnonzero(enough(margin, gain) & ((u != v) | (number[u] > 1)))
    codes = [[int(x) for x in c] for c in top["cell"]]
    kind, schema = "u array<bigint>, v array<bigint>", "left bigint, right bigint, fraction double, margin double, gain double, strict boolean"
    work = float((number[u[keep]].astype(float) * number[v[keep]]).sum())
    pairs = spark.createDataFrame([(codes[i], codes[j]) for i, j in zip(u[keep], v[keep])], kind)
    limit = PAIRS + 16 * ends["n"]
    while work > limit and level < 50:
        level += 1
        fine = cut(cells(level).withColumn("parent", F.transform("cell", lambda c: F.floor(c / 2))))
        side = lambda x: fine.select(F.col("parent").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("cell", "high", "least", "n", "one")))
        met = pairs.join(side("u"), "u").join(side("v"), "v").filter("u <> v or u_cell <= v_cell")
        seen = best[0][4] if best[0] else None

        def bound(frames, seen=seen):
            for f in frames:
                if len(f):
                    _, margin, gain = _gains(stack(f["u_high"]), stack(f["v_high"]), f["u_least"].to_numpy(), f["v_least"].to_numpy())
                    ok = (margin > tol) if strict else np.ones(len(f), bool)
                    if seen is not None:
                        ok &= gain >= seen - 1e-11
                    same = np.array([tuple(x) == tuple(y) for x, y in zip(f["u_cell"], f["v_cell"])])
                    f = f[ok & (~same | (f["u_n"].to_numpy() > 1))].assign(gain=gain[ok & (~same | (f["u_n"].to_numpy() > 1))])
                    pick = lambda c, k: [r[k] for r in f[c]]
                    left, right = (pd.DataFrame({"id": pick(c, "id"), "a": pick(c, "a")}) for c in ("u_one", "v_one"))
                    got = pairs_of(left, right) if len(f) else []
                    out = {"u": f["u_cell"], "v": f["v_cell"], "bound": f["gain"], "n": f["u_n"] * f["v_n"].astype(float)}
                    # the best pair evaluated in this batch goes with its first row
                    out |= {c: [got[0][k] if got and i == 0 else None for i in range(len(f))] for k, c in enumerate(_PAIR)}
                    yield pd.DataFrame(out)

        kept = cut(met.mapInPandas(bound, f"{kind}, bound double, n double, {schema}"))
        seen_here = kept.filter("left is not null").orderBy(F.round("gain", 12).desc(), F.round("margin", 12).desc(), "left", "right").limit(1)
        offer([tuple(r) for r in seen_here.select(*_PAIR).collect()])
        pairs = kept if best[0] is None else kept.filter(F.col("bound") >= F.lit(best[0][4] - 1e-11))
        work = pairs.agg(F.sum("n").alias("s")).first()["s"] or 0.0
        pairs = pairs.select("u", "v")
    member = classes.select(code(level).alias("c"), "id", "a")
    x, y = (member.select(F.col("c").alias(n), F.struct("id", "a").alias(f"{n}_one")) for n in "uv")
    left = pairs.join(x, "u").join(y, "v").filter("u <> v or u_one.id < v_one.id").select("u_one", "v_one")

    def evaluate(frames):
        for f in frames:
            sides = [pd.DataFrame({"id": [r["id"] for r in f[c]], "a": [r["a"] for r in f[c]]}) for c in ("u_one", "v_one")]
            yield pd.DataFrame(pairs_of(*sides) if len(f) else [], columns=_PAIR)

    got = left.mapInPandas(evaluate, schema)
    key = F.struct("strict", F.round("gain", 12), F.round("margin", 12), -F.col("left"), -F.col("right"))
    last = got.agg(F.max_by(F.struct("*"), key).alias("t")).first()["t"]
    if last is not None:
        offer([tuple(last)])
    return best[0]
