"""Distributions over rows and units: mixing, capping, proposals and their responses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.vectors import sum_by
from winnow.plans.bootstrap import interval, replicate_sums
from winnow.plans.converge import require
from winnow.plans.cut import cut
from winnow.plans.ordered import with_group
from winnow.plans.partials import array_sum, stack


def mix(membership: DataFrame, weights: DataFrame) -> DataFrame:
    """(record_id, p): unit memberships (record_id, unit, p) mixed by (unit, w)."""
    rows = membership.join(weights, "unit")
    return rows.groupBy("record_id").agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def executable_distribution(membership: DataFrame, norms: DataFrame, weights: DataFrame) -> DataFrame:
    """(record_id, p, scale): p proportional to the mix of w / norm; a unit of zero norm adds nothing."""
    factor = norms.join(weights, "unit").select(
        "unit",
        F.when(F.col("norm") > 1e-12, F.greatest(F.col("w"), F.lit(0.0)) / F.when(F.col("norm") > 1e-12, F.col("norm")))
        .otherwise(0.0).alias("w"),
    )
    raw = mix(membership, factor)
    total = raw.agg(F.sum("p").alias("s")).select("s").scalar()
    return raw.withColumn("scale", total).withColumn("p", F.when(F.col("scale") > 0, F.col("p") / F.when(F.col("scale") > 0, F.col("scale"))).otherwise(0.0))


def scalar_weights(df: DataFrame, a: str) -> DataFrame:
    """Add q: the softmax of the mean response divided by its population deviation."""
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    rows = df.withColumn("_mean", mean)
    stats = rows.agg((F.stddev_pop("_mean") + F.lit(1e-12)).alias("sd"), F.max("_mean").alias("top"))
    rows = rows.withColumn("_e", F.exp((F.col("_mean") - stats.select("top").scalar()) / stats.select("sd").scalar()))
    return with_group(rows, [], F.sum("_e").alias("_s")).withColumn("q", F.col("_e") / F.col("_s")).drop("_mean", "_e", "_s")


def cap_distribution(
    df: DataFrame, candidate: str, base: str, domain: str | None, lower: float = 0.25, upper: float = 4.0, out: str = "p"
) -> DataFrame:
    """Add out: clip(s * candidate, lower * base, upper * base) with s so that each domain keeps its base mass.

    The mass is piecewise linear in s. A pass evaluates it at a grid of values and at the secant of the
    bracket, which is exact as soon as no row changes its state inside the bracket; a few passes do.
    The brackets of the domains travel as a small table.
    """
    if not 0 <= lower < 1 < upper:
        raise ValueError("invalid probability bounds")
    key = F.lit("all") if domain is None else F.col(domain).cast("string")
    rows = df.withColumn("_d", key).withColumn("_c", F.greatest(F.col(candidate), F.lit(1e-30)))
    slim = cut(rows.select("_d", "_c", (F.col(base) * lower).alias("_lo"), (F.col(base) * upper).alias("_hi"), F.col(base).alias("_b")))
    # Below the smallest lower breakpoint every row is at its lower bound, above the largest upper one at
    # its upper bound: the root lies between.
    brackets = cut(slim.groupBy("_d").agg(
        F.sum("_b").alias("target"), F.min(F.col("_lo") / F.col("_c")).alias("l"), F.sum("_lo").alias("fl"),
        F.max(F.col("_hi") / F.col("_c")).alias("r"), F.sum("_hi").alias("fr"),
    ))
    points = 24
    # Widely spread brackets are searched in the exponent, narrow ones in the value.
    spread = f"transform(sequence(1, {points}), i -> if(l > 0 and r / l > 4, l * pow(r / l, i / {points + 1}D), l + (r - l) * i / {points + 1}D))"
    secant = "if(fr > fl, l + (target - fl) * (r - l) / (fr - fl), l)"
    mass = F.array(*[F.expr(f"sum(least(greatest(grid[{i}] * _c, _lo), _hi))") for i in range(points + 1)]).alias("mass")
    for done in range(1, 201):
        grids = brackets.withColumn("grid", F.expr(f"concat({spread}, array({secant}))"))
        both = grids.join(slim.join(grids.select("_d", "grid"), "_d").groupBy("_d").agg(mass), "_d")
        both = both.withColumn("pts", F.expr("zip_with(grid, mass, (s, f) -> struct(s, f))"))
        both = both.withColumn("below", F.expr("array_max(array_append(filter(pts, p -> p.f < target), struct(l as s, fl as f)))"))
        both = both.withColumn("above", F.expr("array_min(array_append(filter(pts, p -> p.f >= target), struct(r as s, fr as f)))"))
        both = both.withColumn("best", F.expr("array_min(transform(pts, p -> struct(abs(p.f - target) as e, p.s as s)))"))
        step = cut(both.selectExpr("_d", "target", "below.s as l", "below.f as fl", "above.s as r", "above.f as fr", "best.s as s", "best.e / target as e"))
        worst = step.agg(F.max("e").alias("w")).first()["w"]
        brackets = step.drop("s", "e")
        if worst is None or worst < 1e-12:
            break
    require(worst is None or worst < 1e-9, "capped distribution", worst or 0.0, done)
    scale = step.selectExpr("_d", "s as _s")
    clipped = F.expr(f"least(greatest(_s * _c, {base} * {float(lower)!r}D), {base} * {float(upper)!r}D)")
    return rows.join(scale, "_d").withColumn(out, clipped).drop("_d", "_c", "_s")


def check_mass(df: DataFrame, p: str, tol: float = 1e-8) -> None:
    total = df.agg(F.sum(p).alias("s")).first()["s"]
    if abs(total - 1.0) > tol:
        raise ArithmeticError(f"probabilities sum to {total}")


def bounded_proposal(df: DataFrame, base: str, proposal: str, strength: float, max_ratio: float = 4.0, min_base: float = 0.25, out: str = "p") -> DataFrame:
    """Add out: the largest allowed convex mix of base and proposal."""
    if not 0 <= strength <= 1 or max_ratio < 1:
        raise ValueError("invalid distribution constraints")
    ratio = df.agg(F.max(F.col(proposal) / F.col(base)).alias("r")).select("r").scalar()
    rows = df.withColumn("_r", ratio)
    allowed = F.when(F.col("_r") > 1 + 1e-12, F.lit(max_ratio - 1.0) / F.when(F.col("_r") > 1 + 1e-12, F.col("_r") - 1.0)).otherwise(1.0)
    actual = F.least(F.lit(float(strength)), F.lit(1.0 - min_base), allowed)
    return rows.withColumn("_t", actual).withColumn(out, (1 - F.col("_t")) * F.col(base) + F.col("_t") * F.col(proposal)).drop("_r", "_t")


def domain_mass_proposals(df: DataFrame, base: str, domain: str, first, masses: Sequence[float]) -> DataFrame:
    """One proposal per mass: domain `first` gets it, the other domain the rest. Adds (proposal, p)."""
    options = F.array(*[F.struct(F.lit(float(x)).alias("mass"), F.lit(f"domain_mass_{x}").alias("proposal")) for x in masses])
    rows = df.withColumn("_o", F.explode(options))
    factor = F.when(F.col(domain) == first, 2 * F.col("_o.mass")).otherwise(2 * (1 - F.col("_o.mass")))
    return rows.withColumn("proposal", F.col("_o.proposal")).withColumn("p", F.col(base) * factor).drop("_o")


def ht_direction(sample: DataFrame, g: str, q: str, p: str) -> list[float]:
    """Stratified Horvitz-Thompson mixture vector: sum of q / p / n of g over the sampled rows.

    p is the base probability of the row; n the number of rows sampled in all strata.
    """
    total = sum_by(sample, [], g, F.col(q) / F.col(p)).first()
    n = sample.count()
    return [x / n for x in total["s"]]


def ht_response(sample: DataFrame, g: str, q: str, p: str, targets: Sequence[Sequence[float]]) -> DataFrame:
    """(objective, response) of the estimated mixture vector."""
    d = np.asarray(ht_direction(sample, g, q, p))
    out = [(i, float(np.asarray(t) @ d)) for i, t in enumerate(targets)]
    return sample.sparkSession.createDataFrame(out, "objective int, response double")


def proposal_menu(
    proposals: DataFrame, name: str, a: str, m: int, top: int = 4, fractions: Sequence[float] = (0.25, 0.5, 0.75),
    guard: tuple[int, float] | None = None, also: Sequence[Sequence[int]] = (),
) -> DataFrame:
    """(left, right, fraction, score): the best single proposal or pair mix by worst response.

    Responses are linear, so pairs of the `top` best proposals are formed inside one row. `also` adds
    to them the best proposal by the worst of each given group of objectives. With a guard
    (objective, floor) only choices whose guarded response reaches the floor are kept.
    """
    def score(v: Column) -> Column:
        return F.round(F.array_min(v), 12)

    def allowed(v: Column) -> Column:
        return F.lit(True) if guard is None else F.element_at(v, guard[0] + 1) >= guard[1] - 1e-10

    few = proposals.select(F.col(name).alias("name"), F.col(a).alias("a"), score(F.col(a)).alias("s"))
    singles = few.filter(allowed(F.col("a"))).agg(
        F.max_by(F.struct(F.col("name").alias("left"), F.col("name").alias("right"), F.lit(0.0).alias("fraction"), F.col("s").alias("score")),
                 F.struct("s", F.col("name"))).alias("best")
    )
    best = few.orderBy(F.col("s").desc(), F.col("name").desc()).limit(top).select("name", "a")
    for objectives in also:
        part = F.round(F.array_min(F.array(*[F.element_at("a", i + 1) for i in objectives])), 12)
        best = best.unionByName(few.agg(F.max_by(F.struct("name", "a"), F.struct(part, "name")).alias("b")).select("b.*"))
    best = best.dropDuplicates(["name"])
    held = best.agg(F.sort_array(F.collect_list(F.struct("name", "a"))).alias("h"))

    def pair(x: Column, y: Column, f: float) -> Column:
        v = F.zip_with(x["a"], y["a"], lambda u, w: (1 - f) * u + f * w)
        return F.struct(x["name"].alias("left"), y["name"].alias("right"), F.lit(float(f)).alias("fraction"), score(v).alias("score"), allowed(v).alias("ok"))

    pairs = F.flatten(F.transform("h", lambda x: F.flatten(F.transform(
        F.filter("h", lambda y: y["name"] > x["name"]), lambda y: F.array(*[pair(x, y, f) for f in fractions])))))
    mixes = held.select(F.explode(pairs).alias("p")).filter("p.ok").select("p.left", "p.right", "p.fraction", "p.score")
    every = mixes.unionByName(singles.select("best.*"))
    return every.orderBy(F.col("score").desc(), "left", "right", "fraction").limit(1)


def matched_random(df: DataFrame, p: str, stratum: str, out: str = "matched") -> DataFrame:
    """Add out: each stratum's mass spread evenly over its rows."""
    rows = with_group(df, [stratum], F.sum(p).alias("_m"), F.count("*").alias("_n"))
    return rows.withColumn(out, F.col("_m") / F.col("_n")).drop("_m", "_n")


def bootstrap_gap(first: DataFrame, second: DataFrame, weights: Sequence[float], repeats: int = 2000, seed: int = 10043) -> dict:
    """Worst gain of a fixed mix less the best single unit, with a 95% interval.

    first, second: (record_id, gains array<double>) of two tasks, resampled independently.
    """
    w = np.asarray(weights, dtype=float)
    k = len(w)

    def means(df: DataFrame, s: int) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select(F.xxhash64("record_id").alias("h"), "gains")

        def part(frame) -> np.ndarray:
            g = stack(frame["gains"])
            sums, counts = replicate_sums(frame["h"].to_numpy(), g, repeats, s)
            return np.concatenate([sums.ravel(), counts, g.sum(0), [len(g)]])

        out = array_sum(rows, ["h", "gains"], repeats * k + repeats + k + 1, part)
        sums = out[: repeats * k].reshape(repeats, k)
        counts = np.maximum(out[repeats * k : repeats * k + repeats], 1.0)
        return sums / counts[:, None], out[-k - 1 : -1] / max(out[-1], 1.0)

    (ra, ma), (rb, mb) = means(first, seed), means(second, seed + 1)

    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        single = np.maximum(0.0, np.minimum(a, b).max(-1))
        return np.minimum(a @ w, b @ w) - single

    lo, hi = interval(gap(ra, rb))
    return {"gap": float(gap(ma, mb)), "low": lo, "high": hi}
