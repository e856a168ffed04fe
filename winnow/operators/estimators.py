"""Observational estimators, allocations and group rewards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.vectors import dot
from winnow.operators.contracts import rules
from winnow.plans.converge import require
from winnow.plans.cut import cut
from winnow.plans.ordered import with_group
from winnow.plans.partials import array_sum, stack
from winnow.plans.smalllp import game


def propensity_violations(df: DataFrame, key: str, e: str) -> DataFrame:
    """Propensities outside (0, 1]; they are reported, never clipped."""
    return rules(df, key, {"propensity": (F.col(e) > 0) & (F.col(e) <= 1)})


def mar_pseudo(y: Column, observed: Column, e: Column, mu: Column) -> Column:
    """mu + R / e * (y - mu) for one missing-at-random process."""
    return mu + F.when(observed, (y - mu) / e).otherwise(F.lit(0.0))


def mar_dr_mean(df: DataFrame, y: str, observed: str, e: str, mu: str) -> DataFrame:
    pseudo = mar_pseudo(F.col(y), F.col(observed), F.col(e), F.col(mu))
    return df.agg(F.avg(pseudo).alias("estimate"), F.count("*").alias("n"))


def dr_policy_value(df: DataFrame, reward: str, action: str, e: str, pi: str, mu: str) -> DataFrame:
    """(estimate, ess): one-step doubly robust policy value; actions count from 0."""
    at = F.col(action).cast("int") + 1
    ratio = F.element_at(pi, at) / F.col(e)
    pseudo = dot(pi, mu) + ratio * (F.col(reward) - F.element_at(mu, at))
    rows = df.select(pseudo.alias("v"), ratio.alias("r"))
    ess = F.sum("r") * F.sum("r") / (F.sum(F.col("r") * F.col("r")) + F.lit(1e-30))
    return rows.agg(F.avg("v").alias("estimate"), ess.alias("ess"))


def policy_violations(df: DataFrame, key: str, action: str, pi: str) -> DataFrame:
    mass = F.aggregate(pi, F.lit(0.0), lambda acc, x: acc + x)
    return rules(
        df, key,
        {"action": (F.col(action) >= 0) & (F.col(action) < F.size(pi)),
         "policy": F.forall(pi, lambda x: x >= 0) & (F.abs(mass - 1) <= 1e-8)},
    )


def mature(df: DataFrame, t: str, window: float, observed_until: float) -> DataFrame:
    """Rows whose feedback window has closed."""
    if window < 0:
        raise ValueError(f"a maturity window is not negative: {window}")
    return df.filter(F.col(t) + F.lit(window) <= F.lit(observed_until))


def masked_labels(labels: Column | str, mask: Column | str) -> tuple[Column, Column]:
    """Labels with 0 where unknown, together with the mask that says so."""
    y = F.col(labels) if isinstance(labels, str) else labels
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.zip_with(y, m, lambda v, k: F.when(k, v).otherwise(F.lit(0.0))), m


def label_violations(df: DataFrame, key: str, labels: str, mask: str) -> DataFrame:
    known = F.zip_with(labels, mask, lambda v, k: ~k | (v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return rules(df, key, {"label": F.forall(known, lambda ok: F.coalesce(ok, F.lit(False)))})


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def logistic_loss(z: Column, y: Column) -> Column:
    return softplus(z) - y * z


def noise_corrected_loss(z: Column, y: Column, error_rate: float) -> Column:
    """Unbiased logistic loss under symmetric label noise below one half."""
    if not 0 <= error_rate < 0.5:
        raise ValueError("noise below one half required")
    return ((1 - error_rate) * logistic_loss(z, y) - error_rate * logistic_loss(z, 1 - y)) / (1 - 2 * error_rate)


def scalar_allocation(df: DataFrame, p: str, second_moment: str, out: str = "q") -> DataFrame:
    """Add out proportional to p * sqrt(second moment); p itself when all moments are zero."""
    rows = with_group(df.withColumn("_z", F.col(p) * F.sqrt(second_moment)), [], F.sum("_z").alias("_t"))
    share = F.when(F.col("_t") > 0, F.col("_z") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(F.col(p))
    return rows.withColumn(out, share).drop("_z", "_t")


def variance_objectives(df: DataFrame, p: str, q: str, moments: str, m: int) -> DataFrame:
    """(objective, variance): sum of p^2 A / q; infinite when q misses a row that matters."""
    matters = (F.col(p) > 0) & F.exists(moments, lambda a: a > 0)
    lost = F.max(F.when(matters & (F.col(q) <= 0), 1).otherwise(0))
    terms = [
        F.sum(F.when(F.col(q) > 0, F.col(p) * F.col(p) * F.element_at(moments, i + 1) / F.when(F.col(q) > 0, F.col(q)))).alias(f"v{i}")
        for i in range(m)
    ]
    row = df.agg(lost.alias("lost"), *terms)
    each = F.array(*[F.struct(F.lit(i).alias("objective"), F.col(f"v{i}").alias("v")) for i in range(m)])
    return row.select("lost", F.explode(each).alias("o")).select(
        "o.objective", F.when(F.col("lost") == 1, F.lit(float("inf"))).otherwise(F.col("o.v")).alias("variance")
    )


BINS = 2048  # breakpoint bins of a pass


def _levels(rows: DataFrame, witnesses: np.ndarray, floor: float, m: int) -> np.ndarray:
    """For every witness the c with sum of max(floor p, c b) = 1, where b = p sqrt(witness.A).

    A row leaves the floor at its breakpoint floor p / b. One pass adds up p below the floor and b above it by bins of
    breakpoints, for all witnesses; the bin in which the sum crosses one is cut again, until no breakpoint is left
    between its ends or they are equal to the last digit. Inside a bin without breakpoints c is a quotient.
    """
    n = len(witnesses)
    low, high = np.full(n, -745.0), np.full(n, 709.0)  # natural logs of any positive double
    fixed, free = np.zeros(n), np.zeros(n)  # p at the floor above the bin's end, b of rows off the floor before its start
    for _ in range(8):

        def part(frame, low=low, high=high) -> np.ndarray:
            p, moments = frame["p"].to_numpy(float), stack(frame["A"])
            out = np.zeros((n, 3, BINS + 2))
            for i, w in enumerate(witnesses):
                b = p * np.sqrt(np.maximum(moments @ w, 0.0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = np.where(b > 0, np.log(floor * p) - np.log(b), np.inf)
                    at = np.where(p > 0, at, np.inf)
                width = (high[i] - low[i]) / BINS
                k = np.clip(np.floor((at - low[i]) / width) if width > 0 else np.where(at < low[i], -1, BINS), -1, BINS)
                k = np.where(np.isfinite(at), k, BINS).astype(int) + 1
                out[i, 0] = np.bincount(k, p, BINS + 2)
                out[i, 1] = np.bincount(k, b, BINS + 2)
                out[i, 2] = np.bincount(k, minlength=BINS + 2)
            return out.ravel()

        sums = array_sum(rows, ["p", "A"], n * 3 * (BINS + 2), part).reshape(n, 3, BINS + 2)
        settled = True
        for i in range(n):
            p, b, count = sums[i]
            width = (high[i] - low[i]) / BINS
            # at the end of bin k all rows up to it are off the floor
            ends = np.exp(low[i] + width * np.arange(1, BINS + 1))
            off, on = np.cumsum(b)[1:-1], floor * (p.sum() - np.cumsum(p)[1:-1])
            k = int(np.searchsorted(ends * off + on, 1.0))
            if k >= BINS:
                fixed[i], free[i] = floor * p[-1], b[:-1].sum()
                continue
            fixed[i], free[i] = floor * p[k + 2 :].sum(), b[: k + 1].sum()
            if count[k + 1] and width > 1e-15 * max(1.0, abs(low[i])):
                low[i], high[i] = low[i] + k * width, low[i] + (k + 1) * width
                settled = False
            elif count[k + 1]:
                free[i] += b[k + 1]  # breakpoints equal to the last digit: they leave the floor together
        if settled:
            break
    return np.where(free > 0, (1.0 - fixed) / np.maximum(free, 1e-300), 0.0)


def _allocations(rows: DataFrame, witnesses: np.ndarray, floor: float, m: int) -> tuple[list[Column], list[list[float]]]:
    """q = max(floor p, c p sqrt(witness.A)) summing to one, for several witnesses, and the objectives of each."""
    out = []
    for w, c in zip(witnesses, _levels(rows, witnesses, floor, m)):
        b = F.col("p") * F.sqrt(sum((F.element_at("A", i + 1) * F.lit(float(x)) for i, x in enumerate(w)), F.lit(0.0)))
        out.append(F.greatest(F.lit(floor) * F.col("p"), F.lit(float(c)) * b))
    terms = [F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("p") * F.element_at("A", i + 1) / q)).alias(f"v{j}_{i}") for j, q in enumerate(out) for i in range(m)]
    got = rows.agg(*terms).first()
    return out, [[float(got[f"v{j}_{i}"] or 0.0) for i in range(m)] for j in range(len(out))]


def minimax_allocation(
    df: DataFrame, id: str, p: str, moments: str, m: int, floor: float = 0.05, tol: float = 1e-5, rounds: int = 40
) -> tuple[DataFrame, dict]:
    """(id, q) with q >= floor * p that minimizes the largest objective second moment.

    For fixed objective weights q has a closed form; its objectives are a cut for the driver's
    master over m weights, whose mix of earlier allocations is feasible and bounds the optimum. A round tries the
    master's weights and, around them, weights moved towards every objective and towards the best ones met, all in the same passes.
    """
    if not 0 < floor <= 1:
        raise ValueError(f"floor must be above 0 and at most 1, not {floor}")
    rows = cut(df.select(F.col(id).alias("id"), F.col(p).alias("p"), F.col(moments).alias("A")))
    witness, step = np.ones(m) / m, 0.5
    columns: list[Column] = []
    values: list[list[float]] = []
    best_low, at, value, passes = -np.inf, witness, np.inf, 0
    for passes in range(1, rounds + 1):
        near = [(1 - s) * witness + s * e for e in np.eye(m) for s in (step, step / 4)]
        tried = np.unique(np.round([witness, at, (witness + at) / 2, *near], 15), axis=0)
        tried /= tried.sum(1, keepdims=True)
        more, found = _allocations(rows, tried, floor, m)
        lows = [float(w @ np.asarray(v)) for w, v in zip(tried, found)]
        if max(lows) > best_low:
            best_low, at = max(lows), tried[int(np.argmax(lows))]
        columns += more
        values += found
        # min over mixes of the largest objective is a game with negated columns.
        weights, negative, witness = game(-np.asarray(values).T)
        value = -negative
        if value - best_low <= tol * (1 + abs(value)):
            break
        step /= 4
    require(value - best_low <= tol * (1 + abs(value)), "minimax allocation", value - best_low, passes)
    mixed = F.lit(0.0)
    for c, w in zip(columns, weights):
        if w > 0:
            mixed = mixed + F.lit(float(w)) * c
    return rows.select("id", mixed.alias("q")), {"upper": value, "lower": best_low, "gap": value - best_low, "witness": witness.tolist(), "rounds": passes}


def corrected_estimate(draws: DataFrame, values: DataFrame, id: str, x: Sequence[str], p: str, q: str) -> DataFrame:
    """Mean of x * p / q over draws with replacement from q."""
    rows = draws.select(id).join(values, id)
    return rows.agg(*[F.avg(F.col(c) * F.col(p) / F.col(q)).alias(c) for c in x])


def support_violations(values: DataFrame, id: str, p: str, q: str) -> DataFrame:
    return rules(values, id, {"support": (F.col(p) <= 0) | (F.col(q) > 0)})


def cost_allocation(df: DataFrame, p: str, variance: str, cost: str, budget: float, out: str = "n") -> DataFrame:
    """Add out: draws per stratum proportional to p * sqrt(variance / cost), spending the budget."""
    if budget <= 0:
        raise ValueError(f"budget must be above 0, not {budget}")
    rows = df.withColumn("_z", F.col(p) * F.sqrt(F.col(variance) / F.col(cost)))
    rows = with_group(rows, [], F.sum(F.col(cost) * F.col("_z")).alias("_t"))
    share = F.when(F.col("_t") > 0, F.lit(float(budget)) * F.col("_z") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(0.0)
    return rows.withColumn(out, share).drop("_z", "_t")


def group_advantages(df: DataFrame, prompt: str, rewards: Sequence[str], mode: str = "loo") -> DataFrame:
    """Add adv_<reward>: leave-one-out or standardised advantages inside each prompt's group."""
    if mode not in {"loo", "grpo"}:
        raise ValueError("mode must be loo or grpo")
    aggs = [F.count("*").alias("_n")]
    for c in rewards:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    rows = with_group(df, [prompt], *aggs)
    for c in rewards:
        centered = F.col(c) - F.col(f"_m_{c}")
        if mode == "loo":
            adv = centered * F.col("_n") / F.when(F.col("_n") > 1, F.col("_n") - 1)
        else:
            adv = centered / F.greatest(F.col(f"_s_{c}"), F.lit(1e-8))
        rows = rows.withColumn(f"adv_{c}", adv)
    return rows.drop("_n", *[f"_{k}_{c}" for c in rewards for k in "ms"])


def small_groups(df: DataFrame, prompt: str) -> DataFrame:
    """Prompts with fewer than two samples."""
    return df.groupBy(prompt).agg(F.count("*").alias("n")).filter("n < 2")


def policy_surrogate(
    df: DataFrame, prompt: str, logp: str, old: str, advantages: Sequence[str], weights: Sequence[float],
    prompt_ratio: str | None = None, clip: float | None = None,
) -> DataFrame:
    """One row: minus the mean over prompts of the mean ratio * advantage, without self-normalising."""
    if abs(sum(weights) - 1) > 1e-8 or min(weights) < 0:
        raise ValueError("objective weights must sum to one")
    adv = sum((F.col(c) * F.lit(float(w)) for c, w in zip(advantages, weights)), F.lit(0.0))
    ratio = F.exp(F.col(logp) - F.col(old))
    term = ratio * adv
    if clip is not None:
        if not 0 < clip < 1:
            raise ValueError("invalid clip")
        held = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
        term = F.least(term, held * adv)
    factor = F.lit(1.0) if prompt_ratio is None else F.max(prompt_ratio)
    per = df.groupBy(prompt).agg((-F.avg(term) * factor).alias("v"))
    return per.agg(F.avg("v").alias("surrogate"), F.count("*").alias("prompts"))


def categorical_kl(df: DataFrame, prompt: str, logp: str, ref: str) -> DataFrame:
    return df.groupBy(prompt).agg(F.sum(F.exp(logp) * (F.col(logp) - F.col(ref))).alias("kl"))


def feedback_metrics(df: DataFrame, logits: str, labels: str, m: int) -> DataFrame:
    """(objective, bce, brier, n): means over the known labels of each objective."""
    aggs = []
    for i in range(m):
        z, y = F.element_at(logits, i + 1), F.element_at(labels, i + 1)
        prob = 1 / (1 + F.exp(-z))
        aggs += [
            F.avg(F.when(y.isNotNull(), logistic_loss(z, y))).alias(f"b{i}"),
            F.avg(F.when(y.isNotNull(), (prob - y) * (prob - y))).alias(f"r{i}"), F.count(y).alias(f"n{i}"),
        ]
    each = F.array(*[
        F.struct(F.lit(i).alias("objective"), F.col(f"b{i}").alias("bce"), F.col(f"r{i}").alias("brier"), F.col(f"n{i}").alias("n"))
        for i in range(m)
    ])
    return df.agg(*aggs).select(F.explode(each).alias("o")).select("o.*")


def row_token_loss(df: DataFrame, record: str, label: str, loss: str) -> DataFrame:
    """(record, loss, tokens): the mean loss of each record's supervised tokens."""
    return df.filter(F.col(label) != -100).groupBy(record).agg(F.avg(loss).alias("loss"), F.count("*").alias("tokens"))


def reduce_token_loss(df: DataFrame, record: str, label: str, loss: str) -> DataFrame:
    """One row: token mean and example mean over supervised tokens (label other than -100)."""
    per = df.filter(F.col(label) != -100).groupBy(record).agg(F.sum(loss).alias("s"), F.count("*").alias("c"))
    return per.agg(
        (F.sum("s") / F.sum("c")).alias("token_mean"), F.avg(F.col("s") / F.col("c")).alias("example_mean"),
        F.sum("c").alias("tokens"), F.count("*").alias("records"),
    )


def reward_groups(df: DataFrame, record: str, answer: str, candidate: str) -> DataFrame:
    """(record, reward_mean, samples, mixed): exact-match rewards of each group's samples."""
    reward = F.when(F.col(candidate) == F.col(answer), 1.0).otherwise(0.0)
    return df.groupBy(record).agg(
        F.avg(reward).alias("reward_mean"), F.count("*").alias("samples"), (F.min(reward) < F.max(reward)).alias("mixed")
    )
