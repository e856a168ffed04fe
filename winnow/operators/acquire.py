"""Acquisition ranking, eligibility, coverage and experiment design."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.vectors import dot_with
from winnow.operators.contracts import require_clean, rules
from winnow.operators.frontier import frontier_weights
from winnow.plans.converge import require
from winnow.plans.cut import cut
from winnow.plans.partials import array_sum, stack
from winnow.plans.smalllp import game

# The vocabularies of preference pairs and verifiers.
SOURCES = ("observed", "expert", "simulator", "synthetic")
PAIR_SPLITS = ("train", "validation", "test")
VERIFIERS = ("execution", "expert", "documented_interface")


def pair_violations(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, rule) for trivial or untraceable pairs and fields outside their vocabulary."""
    return rules(
        pairs, key,
        {
            "trivial": F.col("chosen") != F.col("rejected"),
            "prompt_id": F.length("prompt_id") > 0,
            "evidence_id": F.length("evidence_id") > 0,
            "source": F.col("source").isin(*SOURCES),
            "confidence": (F.col("confidence") >= 0) & (F.col("confidence") <= 1),
            "split": F.col("split").isin(*PAIR_SPLITS),
        },
    )


def accept_pairs(pairs: DataFrame, min_confidence: float = 0.8, allow_synthetic: bool = False, check: bool = True) -> DataFrame:
    """Training pairs above the confidence floor; held-out pairs are an error."""
    if not 0 <= min_confidence <= 1:
        raise ValueError("the confidence threshold must be from 0 to 1")
    if check:
        require_clean(pairs.filter("split <> 'train'").select("prompt_id", "split"), "held-out labels")
    kept = pairs.filter(F.col("confidence") >= min_confidence)
    return kept if allow_synthetic else kept.filter(~F.col("source").isin("synthetic", "simulator"))


def rank_acquisition(df: DataFrame, id: str, a: str, u: str, cost: str, witness: Sequence[float], margin: float, k: int | None = None) -> DataFrame:
    """(id, score) by (witness.(a - u) - margin) / cost; the margin is subtracted before dividing."""
    lower = F.zip_with(a, u, lambda x, y: x - y)
    score = (dot_with(lower, witness) - F.lit(float(margin))) / F.col(cost)
    rows = df.select(F.col(id), score.alias("score"))
    return rows if k is None else rows.orderBy(F.round("score", 12).desc(), id).limit(k)


@dataclass(frozen=True)
class _Node:
    """A part of the sets of new columns: these are bought, these never."""

    bought: frozenset = frozenset()
    never: frozenset = frozenset()
    bound: float = float("inf")


def best_small_batch(existing: DataFrame, new: DataFrame, id: str, a: str, cost: str, budget: float, m: int, tol: float = 1e-9, wave: int = 16, rounds: int = 10_000) -> dict:
    """An affordable set of new columns with the largest frontier margin, by branch and bound.

    A node of the tree has some columns bought and some excluded; with every column allowed that the rest of the budget can
    buy alone, its margin is a bound, and it is exact where the columns it uses fit the budget together. Otherwise one
    of them is bought in one child and excluded in the other. An optimal mix has at most one column per objective, so no
    node buys more than m. The bounds come from games over the few columns generated so far, priced over both tables
    with the witnesses of a whole wave of nodes at once: one aggregate a table and round, whatever the pool and the number
    of sets. No column of the result can be left out without loss. Ids of new columns are unique, costs not negative.
    """
    old = cut(existing.select(F.col(id).alias("id"), F.col(a).cast("array<double>").alias("a")))
    offered = cut(new.filter((F.col(cost) >= 0) & (F.col(cost) <= budget)).select(F.col(id).alias("id"), F.col(a).cast("array<double>").alias("a"), F.col(cost).cast("double").alias("c")))
    held: list[np.ndarray] = []  # columns of the existing pool
    known: dict = {}  # new columns met so far: (responses, cost)

    def price(nodes: list[_Node], witnesses: list[np.ndarray]) -> list[float]:
        """For every node the best value of any column it allows; the columns found join the games."""
        tops = old.agg(*[F.max_by("a", F.struct(dot_with("a", w), "id")).alias(f"s{i}") for i, w in enumerate(witnesses)]).first()
        picks = []
        for i, (n, w) in enumerate(zip(nodes, witnesses)):
            free = budget - sum(known[j][1] for j in n.bought)
            ok = (F.col("c") <= F.lit(float(free) + tol)) & F.lit(len(n.bought) < m)
            shut = n.bought | n.never
            if shut:
                ok = ok & ~F.col("id").isin(sorted(shut))
            picks.append(F.max_by(F.struct("id", "a", "c"), F.when(ok, F.struct(dot_with("a", w), "id"))).alias(f"s{i}"))
        news = offered.agg(*picks).first()
        out = []
        for n, w, top, best in zip(nodes, witnesses, tops, news):
            values = [float(w @ known[j][0]) for j in n.bought]
            if top is not None:
                held.append(np.asarray(top, dtype=float))
                values.append(float(w @ held[-1]))
            if best is not None:
                known[best["id"]] = np.asarray(best["a"], dtype=float), best["c"]
                values.append(float(w @ known[best["id"]][0]))
            out.append(max(values))
        return out

    def allowed(n: _Node) -> list:
        free = budget - sum(known[j][1] for j in n.bought)
        more = [j for j, (_, c) in known.items() if j not in n.bought and j not in n.never and c <= free + tol] if len(n.bought) < m else []
        return [*n.bought, *more]

    def solve(nodes: list[_Node]) -> list[tuple]:
        """(bound, margin, weights of new columns) of every node, to within tol of each other."""
        done: dict = {}
        for _ in range(rounds):
            open_ = [n for n in nodes if n not in done]
            if not open_:
                return [done[n] for n in nodes]
            games = []
            for n in open_:
                ids = allowed(n)
                columns = [*held, *(known[j][0] for j in ids)]
                q, margin, witness = game(np.stack(columns, axis=1)) if columns else (np.zeros(0), -np.inf, np.full(m, 1.0 / m))
                games.append((margin, dict(zip(ids, q[len(held):] if len(columns) else [])), witness))
            tops = price(open_, [g[2] for g in games])
            for n, (margin, weights, _), top in zip(open_, games, tops):
                if top - margin <= tol * (1 + abs(margin)) or top <= best[0] + tol:
                    done[n] = (top, margin, weights)
            unique = {h.tobytes(): h for h in held}
            held[:] = list(unique.values())
        require(False, "batch bounds", float("inf"), rounds)

    best: list = [-np.inf, []]
    base = best[0] = _frontier_margin(old, m, held)
    queue, count = [_Node()], 0
    while queue:
        queue.sort(key=lambda n: -n.bound)
        nodes, queue = queue[:wave], queue[wave:]
        count += len(nodes)
        for n, (top, margin, weights) in zip(nodes, solve(nodes)):
            if top <= best[0] + tol:
                continue
            used = [j for j, q in weights.items() if q > 1e-12]
            if sum(known[j][1] for j in used) <= budget + tol:
                if margin > best[0] + tol:
                    best[:] = [margin, used]
                continue  # what the node uses can be bought, so its bound is met
            j = max((j for j in used if j not in n.bought), key=lambda j: (weights[j], str(j)))
            queue += [_Node(n.bought | {j}, n.never, top), _Node(n.bought, n.never | {j}, top)]
        queue = [n for n in queue if n.bound > best[0] + tol]
    chosen = sorted(best[1], key=str)
    for j in list(chosen):  # a column that the rest replaces is left out
        rest = [known[i][0] for i in chosen if i != j]
        columns = [*held, *rest]
        if columns and game(np.stack(columns, axis=1))[1] >= best[0] - tol:
            chosen.remove(j)
    return {"selected": [str(j) for j in chosen], "new_margin": best[0], "gain": best[0] - base if np.isfinite(base) else best[0],
            "nodes": count, "columns": len(held) + len(known)}


def _frontier_margin(pool: DataFrame, m: int, held: list) -> float:
    """The margin of the existing pool alone, whose columns join `held`; minus infinity for an empty pool."""
    if pool.isEmpty():
        return -np.inf
    found = frontier_weights(pool, "id", "a", m)
    ids = pool.filter(F.col("id").isin(list(found.weights))).select("a").collect()  # at most m rows
    held += [np.asarray(r["a"], dtype=float) for r in ids]
    return found.margin


def eligible(prefix: str, memory: float, equipment: Sequence[str], time: float) -> Column:
    """Whether a candidate (struct or flat columns under prefix) can run now with the given means."""
    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    own = F.array(*[F.lit(x) for x in equipment]) if equipment else F.array().cast("array<string>")
    ok = (
        (F.length(c("candidate_id")) > 0) & (F.length(c("evidence_id")) > 0)
        & finite(c("required_memory_gb")) & (c("required_memory_gb") >= 0) & (c("required_memory_gb") <= memory)
        & finite(c("available_at")) & (c("available_at") <= time)
        & (F.size(F.array_except(c("required_equipment"), own)) == 0)
    )
    return F.coalesce(ok, F.lit(False))


def eligible_candidates(df: DataFrame, memory: float, equipment: Sequence[str], time: float) -> DataFrame:
    return df.filter(eligible("", memory, equipment, time))


def eligible_bundles(bundles: DataFrame, candidates: DataFrame, memory: float, equipment: Sequence[str], time: float) -> DataFrame:
    """Bundles with a whitelisted verifier, current evidence and two eligible parts.

    bundles: (bundle_id, method_id, dataset_id, compatibility_evidence_id, verifier, verified_at, compatible).
    """
    able = eligible_candidates(candidates, memory, equipment, time).select("candidate_id")
    sound = bundles.filter(
        F.col("verifier").isin(*VERIFIERS) & (F.length("bundle_id") > 0) & (F.length("compatibility_evidence_id") > 0)
        & F.col("compatible") & ~F.isnan("verified_at") & (F.col("verified_at") <= time)
    )
    first = sound.join(able.withColumnRenamed("candidate_id", "method_id"), "method_id", "left_semi")
    return first.join(able.withColumnRenamed("candidate_id", "dataset_id"), "dataset_id", "left_semi")


def coverage_value(df: DataFrame, capability: str, p: str, weight: str) -> DataFrame:
    """(value): weighted sum over capabilities of 1 - product of (1 - p) over the rows of df."""
    sure = F.max(F.when(F.col(p) >= 1, 1).otherwise(0)) == 1
    miss = F.exp(F.sum(F.when(F.col(p) < 1, F.log1p(-F.col(p)))))
    per = df.groupBy(capability).agg(
        F.when(sure, 1.0).otherwise(1 - F.coalesce(miss, F.lit(1.0))).alias("covered"), F.max(weight).alias("w")
    )
    return per.agg(F.coalesce(F.sum(F.col("covered") * F.col("w")), F.lit(0.0)).alias("value"))


def greedy_coverage(df: DataFrame, id: str, p: str, weights: Sequence[float], k: int) -> tuple[list, float]:
    """k rows of best marginal coverage, ties by lowest id; p is an array over capabilities.

    The driver keeps one number per capability; each round is one aggregate over the pool.
    """
    w = np.asarray(weights, dtype=float)
    pool = cut(df.select(F.col(id).alias("id"), F.col(p).alias("p")))
    left, chosen, value = np.ones(len(w)), [], 0.0
    for _ in range(k):
        rest = pool.filter(~F.col("id").isin(chosen)) if chosen else pool
        gain = F.round(dot_with("p", w * left), 12)
        best = rest.agg(F.max_by(F.struct("id", "p"), F.struct(gain, -F.col("id"))).alias("b")).first()["b"]
        if best is None:
            raise ValueError(f"{k} rows asked for, {len(chosen)} there")
        probs = np.asarray(best["p"], dtype=float)
        value += float((w * left) @ probs)
        left = left * (1 - probs)
        chosen.append(best["id"])
    return chosen, value


def _root(covariance: np.ndarray) -> np.ndarray:
    s = np.asarray(covariance, dtype=float)
    if not np.allclose(s, s.T):
        raise ValueError("the covariance must equal its transpose")
    eig, u = np.linalg.eigh(s)
    if eig.min() < -1e-10:
        raise ValueError("the covariance has a negative eigenvalue")
    return (u * np.sqrt(np.maximum(eig, 0))) @ u.T


def gaussian_information(df: DataFrame, x: str, covariance: np.ndarray, noise: float) -> float:
    """Half the log determinant of I + root.X'X.root / noise over all rows of df."""
    if noise <= 0:
        raise ValueError(f"noise must be above 0, not {noise}")
    d = len(covariance)
    gram = array_sum(df, [x], d * d, lambda f: (stack(f[x]).T @ stack(f[x])).ravel()).reshape(d, d)
    root = _root(covariance)
    return 0.5 * float(np.linalg.slogdet(np.eye(d) + root @ gram @ root / noise)[1])


def greedy_information(df: DataFrame, id: str, x: str, covariance: np.ndarray, noise: float, k: int) -> tuple[list, float]:
    """k rows of best information gain: the coverage part of the block-greedy selection with unit costs."""
    from winnow.operators.selection import SelectConfig, budgeted_select

    scale = _root(covariance) / np.sqrt(noise)

    def project(frames):
        for frame in frames:
            z = stack(frame["x"]) @ scale if len(frame) else []
            yield pd.DataFrame({"id": frame["id"], "z": list(z)})

    z = df.select(F.col(id).cast("bigint").alias("id"), F.col(x).cast("array<double>").alias("x")).mapInPandas(project, "id bigint, z array<double>")
    pool = z.select("id", "z", F.lit(1).cast("bigint").alias("cost"), F.lit("all").alias("cell"), F.col("id").cast("string").alias("grp"), F.lit(0.0).alias("utility"))
    picked, report = budgeted_select(pool, SelectConfig(budget=k, ridge=1.0, keep_all_when_fits=False, stop_nonpositive=False))
    order = [r["id"] for r in picked.orderBy("rank").collect()]  # k rows, the caller's cardinality
    return order, 0.5 * report["coverage"]


def posterior_update(df: DataFrame, x: str, y: str, mean: np.ndarray, covariance: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian linear posterior after all observations of df; one pass, any order."""
    mu, s = np.asarray(mean, dtype=float), np.asarray(covariance, dtype=float)
    d = len(mu)

    def part(frame) -> np.ndarray:
        m, t = stack(frame[x]), frame[y].to_numpy(dtype=float)
        return np.concatenate([(m.T @ m).ravel(), m.T @ t])

    out = array_sum(df, [x, y], d * d + d, part)
    gram, cross = out[: d * d].reshape(d, d), out[d * d :]
    # Written without the inverse of the prior, which may be singular.
    system = np.eye(d) + s @ gram / noise
    post = np.linalg.solve(system, s)
    post = (post + post.T) / 2
    return mu + post @ (cross - gram @ mu) / noise, post
