"""Frontier weights, bounds and mixtures: known answers and brute force on small tables."""

import itertools

import numpy as np
import pytest

from winnow.operators import acquire as A
from winnow.operators import frontier as P
from winnow.operators import mixtures as X
from winnow.operators.estimators import minimax_allocation
from winnow.plans.converge import NotConverged
from winnow.plans.smalllp import game


def columns(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, a array<double>")


def test_complementary_pair_has_margin_one_half(spark):
    zero, left, right = (0, 0), (2, -1), (-1, 2)
    assert P.frontier_weights(columns(spark, [zero, left]), "id", "a", 2).margin == pytest.approx(0)
    both = P.frontier_weights(columns(spark, [zero, left, right]), "id", "a", 2)
    assert both.margin == pytest.approx(0.5) and both.certified
    assert both.weights == {1: pytest.approx(0.5), 2: pytest.approx(0.5)}
    gain = P.dual_face_gain(columns(spark, [zero]), columns(spark, [left, right]), "id", "a", 2)
    assert gain["gain"] == pytest.approx(0.5, abs=1e-6) and gain["positive"]


def test_adding_a_bridge_column(spark):
    assert P.frontier_weights(columns(spark, [(1, -2), (-2, 1)]), "id", "a", 2).margin == pytest.approx(-0.5)
    assert P.frontier_weights(columns(spark, [(1, -2), (-2, 1), (1, 1)]), "id", "a", 2).margin == pytest.approx(1.0)


@pytest.mark.parametrize("seed", [0, 1])
def test_priced_frontier_equals_the_whole_game(spark, seed):
    a = np.random.default_rng(seed).normal(size=(200, 3))
    got = P.frontier_weights(columns(spark, a), "id", "a", 3)
    _, value, _ = game(a.T)
    assert got.margin == pytest.approx(value, abs=1e-9) and got.certified and sum(got.weights.values()) == pytest.approx(1)


def test_dual_face_gain_is_the_margin_slope(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) + 0.4
    got = P.dual_face_gain(columns(spark, a), columns(spark, b), "id", "a", 3)
    _, old, _ = game(a.T)
    # The value with mass eps on the new columns, by a game over mixed columns.
    eps = 1e-5
    mixed = np.asarray([(1 - eps) * x + eps * y for x in a for y in b])
    assert got["gain"] == pytest.approx((game(mixed.T)[1] - old) / eps, abs=1e-3)


def test_opportunity_keeps_no_update(spark):
    out = P.opportunity(columns(spark, [(-1, -1), (-2, 1)]), "id", "a", 2)
    assert out["single_margin"] == 0 and out["mixed_margin"] == pytest.approx(0) and out["gap"] == pytest.approx(0)


@pytest.mark.parametrize("multiple,floor", [(4.0, 0.0), (3.0, 0.3)])
def test_capped_frontier_matches_projected_search(spark, multiple, floor):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(30, 2))
    q, info = P.capped_frontier(columns(spark, a), "id", "a", 2, multiple, floor)
    w = np.asarray([r["q"] for r in q.orderBy("id").collect()])
    n = len(a)
    assert w.sum() == pytest.approx(1) and w.min() >= floor / n - 1e-12 and w.max() <= multiple / n + 1e-12
    assert (a.T @ w).min() == pytest.approx(info["margin"], abs=1e-9) and info["certified"]
    # Two objectives: the dual is one number, so a fine scan bounds the optimum from above.
    best = np.inf
    for t in np.linspace(0, 1, 4001):
        s = a @ np.asarray([t, 1 - t])
        order, left, value = np.argsort(-s), 1 - floor, (floor / n) * s.sum()
        for i in order:
            give = min(left, (multiple - floor) / n)
            value, left = value + give * s[i], left - give
        best = min(best, value)
    assert info["margin"] == pytest.approx(best, abs=1e-4)


def test_capped_frontier_with_many_equal_rows(spark):
    """A third of the rows share one score: the threshold spreads its mass over all of them."""
    rows = [(1.0, 1.0)] * 10 + [(0.5, 0.5)] * 10 + [(0.0, 0.0)] * 10
    q, info = P.capped_frontier(columns(spark, rows), "id", "a", 2, 2.0)
    w = np.asarray([r["q"] for r in q.orderBy("id").collect()])
    assert w[:10] == pytest.approx(2 / 30) and w[10:20] == pytest.approx(1 / 30) and w[20:] == pytest.approx(0)


def test_guarded_weights(spark):
    a = np.asarray([(1.0, -1.0), (0.2, 0.5), (0.0, 0.0), (0.6, 0.1)])
    q, info = P.guarded_weights(columns(spark, a), "id", "a", 2, [1, 0], {1: 0.05}, 4.0)
    w = np.asarray([r["q"] for r in q.orderBy("id").collect()])
    assert w.sum() == pytest.approx(1) and (a.T @ w)[1] >= 0.05 - 1e-9
    grid = [(x, y, z) for x in np.linspace(0, 1, 41) for y in np.linspace(0, 1 - x, 41) for z in (0.0,)]
    best = max(a[0, 0] * x + a[1, 0] * y + a[3, 0] * (1 - x - y) for x, y, _ in grid if x + y <= 1 and (a[0, 1] * x + a[1, 1] * y + a[3, 1] * (1 - x - y)) >= 0.05)
    assert info["primary"] >= best - 1e-9
    with pytest.raises(ValueError, match="infeasible"):
        P.guarded_weights(columns(spark, a), "id", "a", 2, [1, 0], {1: 0.9}, 4.0)


def test_response_interval_known_answer(spark):
    targets = spark.createDataFrame([(0, [1.0]), (0, [1.0])], "o int, v array<double>")
    updates = spark.createDataFrame([(0, [1.0])], "id bigint, v array<double>")
    row = P.response_interval(targets, "o", "v", updates, "id", "v", 1.0).first()
    assert row["mean"] == pytest.approx(1.0) and row["mean"] - row["radius"] == pytest.approx(-0.920646, abs=1e-5)


def every_pair(values, tol=1e-9):
    """The best pair by trying all, each over all fractions at which two objectives meet."""
    best = None
    for i, l in enumerate(values):
        for j in range(i + 1, len(values)):
            r = values[j]
            slope = r - l
            fractions = [0.0, 1.0]
            for x in range(len(l)):
                for y in range(x):
                    if abs(slope[x] - slope[y]) > 1e-14:
                        fractions.append((l[y] - l[x]) / (slope[x] - slope[y]))
            margin = max(min(l + f * slope) for f in fractions if 0 <= f <= 1)
            gain = margin - max(0.0, min(l), min(r))
            strict = bool(min(l) <= tol and min(r) <= tol and margin > tol)
            row = (strict, round(gain, 12), round(margin, 12), -i, -j)
            best = row if best is None else max(best, row)
    return best


@pytest.mark.parametrize("seed", range(7))
def test_best_pair_equals_all_pairs(spark, monkeypatch, seed):
    """Also when cells split many times; with ties, copies, pools without a strict pair and pools of copies only."""
    monkeypatch.setattr(P, "CELLS", [512, 8, 2, 8, 8, 8, 2][seed])
    monkeypatch.setattr(P, "PAIRS", [200_000, 0, -1600, -3000, -900, 0, -3000][seed])
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(60, 3)) if seed < 4 else np.round(rng.normal(size=(60, 3)))  # many equal responses
    if seed == 3:
        values = np.abs(values) + 1  # all singles succeed
    if seed == 5:
        values = np.tile([[1.0, -2.0, 0.5]], (9, 1))
    if seed == 6:
        values = np.column_stack([np.linspace(-1, 1, 60), np.linspace(1, -1, 60), np.zeros(60)])  # every pair alike
    want = every_pair(values)
    got = P.best_pair(columns(spark, values), "id", "a", values.shape[1]).first()
    assert (got["strict"], round(got["gain"], 9), round(got["margin"], 9), -got["left"], -got["right"]) == (want[0], round(want[1], 9), round(want[2], 9), *want[3:])


def test_best_pair_of_few(spark):
    assert P.best_pair(columns(spark, [(2, -1), (-1, 2), (0.1, 0.1)]), "id", "a", 2).first()["strict"]
    assert P.best_pair(columns(spark, [(2, -1)]), "id", "a", 2).count() == 0


def test_kth_largest_with_ties(spark):
    values = [5.0] * 7 + [3.0] * 2 + [1.0, -2.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for k in (1, 7, 8, 9, 10, 11):
        x, above, equal = P.kth_largest(df, "s", k, bins=2)
        assert x == sorted(values, reverse=True)[k - 1] and above == sum(v > x for v in values) and equal == values.count(x)


def test_cap_distribution_keeps_domain_mass(spark):
    rng = np.random.default_rng(1)
    data = [(i, "a" if i < 12 else "b", float(np.exp(4 * rng.normal())), 0.5 / 12 if i < 12 else 0.5 / 18) for i in range(30)]
    df = spark.createDataFrame(data, "id bigint, d string, c double, b double")
    got = X.cap_distribution(df, "c", "b", "d")
    X.check_mass(got, "p")
    rows = got.collect()
    assert sum(r["p"] for r in rows if r["d"] == "a") == pytest.approx(0.5)
    for r in rows:
        assert 0.25 * r["b"] - 1e-12 <= r["p"] <= 4 * r["b"] + 1e-12
    free = [r["p"] / r["c"] for r in rows if r["d"] == "a" and 0.25001 * r["b"] < r["p"] < 3.9999 * r["b"]]
    assert max(free) == pytest.approx(min(free), rel=1e-9)


def test_minimax_allocation_known_answer(spark):
    df = spark.createDataFrame([(0, 0.7, [1.0, 2.0]), (1, 0.2, [9.0, 1.0]), (2, 0.1, [4.0, 12.0])], "id bigint, p double, A array<double>")
    q, info = minimax_allocation(df, "id", "p", "A", 2, 0.05)
    assert info["upper"] == pytest.approx(2.53569, abs=1e-4)
    assert [r["q"] for r in q.orderBy("id").collect()] == pytest.approx([0.56284, 0.24757, 0.18979], abs=2e-3)


def test_bootstrap_gap_contains_its_point(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(200)], "record_id bigint, gains array<double>")
    out = X.bootstrap_gap(df, df, [0.5, 0.5], 400)
    assert out["low"] < out["high"] and out["low"] - 0.1 <= out["gap"] <= out["high"] + 0.1


def test_acquisition_known_answers(spark):
    a = spark.createDataFrame([(0, [1.0, 1.0], [0.1, 0.1], 2.0), (1, [-0.2, -0.1], [0.1, 0.1], 1.0)], "id bigint, a array<double>, u array<double>, c double")
    got = {r["id"]: r["score"] for r in A.rank_acquisition(a, "id", "a", "u", "c", [0.5, 0.5], -0.5).collect()}
    assert got == {0: pytest.approx(0.7), 1: pytest.approx(0.25)}
    p = spark.createDataFrame([(i, r) for i, r in enumerate([[.9, .1, 0.], [.8, .1, 0.], [0., .8, .7], [.1, .1, .9]])], "id bigint, p array<double>")
    chosen, value = A.greedy_coverage(p, "id", "p", [1, 1, 1], 2)
    assert chosen == [2, 0] and value == pytest.approx(2.42)
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [0.0, 1.0])], "id bigint, x array<double>")
    chosen, value = A.greedy_information(x, "id", "x", np.eye(2), 0.2, 2)
    assert chosen == [0, 2] and value == pytest.approx(1.791759, abs=1e-6)
    assert A.gaussian_information(x.filter("id < 2"), "x", np.eye(2), 0.2) == pytest.approx(1.194542, abs=1e-6)
    one = spark.createDataFrame([([1.0, 0.0], 2.0)], "x array<double>, y double")
    mean, cov = A.posterior_update(one, "x", "y", np.zeros(2), np.eye(2), 1.0)
    assert mean == pytest.approx([1.0, 0.0]) and cov == pytest.approx(np.diag([0.5, 1.0]))


def test_best_small_batch_finds_the_pair(spark):
    new = spark.createDataFrame([(0, [2.0, -1.0], 1.0), (1, [-1.0, 2.0], 1.0), (2, [0.1, 0.1], 1.0)], "id bigint, a array<double>, c double")
    out = A.best_small_batch(columns(spark, [(0, 0), (-1, -1)]), new, "id", "a", "c", 2, 2)
    assert sorted(out["selected"]) == ["0", "1"] and out["new_margin"] == pytest.approx(0.5)


def test_best_batch_of_four_objectives_takes_four_columns(spark):
    new = spark.createDataFrame([(i, [3.0 if i == j else -0.5 for j in range(4)], 1.0) for i in range(5)], "id bigint, a array<double>, c double")
    out = A.best_small_batch(columns(spark, [(-1, -1, -1, -1)]), new, "id", "a", "c", 4, 4)
    assert sorted(out["selected"]) == ["0", "1", "2", "3"] and out["new_margin"] == pytest.approx((3 - 1.5) / 4)


@pytest.mark.parametrize("seed", range(6))
def test_best_batch_equals_every_set(spark, seed):
    """The margin of the best affordable set of up to m columns, and a set that attains it and cannot lose a column."""
    rng = np.random.default_rng(seed)
    m, n = 3, 9
    old, new = rng.normal(size=(12, m)) - 0.8, rng.normal(size=(n, m))
    costs = rng.integers(1, 6, n).astype(float)
    budget = float([3, 5, 7, 9, 0.5, 6][seed])
    if seed == 5:
        new[1::2] = new[::2][: len(new[1::2])]  # copies at other prices
    table = spark.createDataFrame([(i, new[i].tolist(), float(costs[i])) for i in range(n)], "id bigint, a array<double>, c double")
    out = A.best_small_batch(columns(spark, old), table, "id", "a", "c", budget, m)
    base = game(old.T)[1]
    sets = [s for size in range(m + 1) for s in itertools.combinations(range(n), size) if costs[list(s)].sum() <= budget]
    margin = lambda s: game(np.column_stack([old.T, new[list(s)].T]))[1]
    want = max(map(margin, sets))
    assert out["new_margin"] == pytest.approx(want, abs=1e-7) and out["gain"] == pytest.approx(want - base, abs=1e-7)
    mine = [int(i) for i in out["selected"]]
    assert costs[mine].sum() <= budget and margin(mine) == pytest.approx(want, abs=1e-7)
    assert all(margin([i for i in mine if i != j]) < want - 1e-9 for j in mine)


def test_best_batch_does_not_refuse_by_number(spark):
    """Two hundred columns have a million sets of three; few nodes of the tree are opened."""
    rng = np.random.default_rng(9)
    new = rng.normal(size=(200, 3))
    table = spark.createDataFrame([(i, new[i].tolist(), 1.0) for i in range(200)], "id bigint, a array<double>, c double")
    out = A.best_small_batch(columns(spark, rng.normal(size=(50, 3)) - 2), table, "id", "a", "c", 2, 3)
    pairs = max(game(new[[i, j]].T)[1] for i in range(200) for j in range(i))
    assert out["new_margin"] == pytest.approx(max(pairs, new.min(1).max()), abs=1e-7) and out["nodes"] < 2000


def test_proposal_menu_guard_and_extra_candidates(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0, -1.0]), ("b", [0.0, 3.0, 0.0]), ("c", [0.1, 0.1, 2.0])], "n string, a array<double>")
    row = X.proposal_menu(df, "n", "a", 3, top=1, also=[(0,), (1,)]).first()
    assert (row["left"], row["right"]) in {("a", "c"), ("b", "c"), ("c", "c")} and row["score"] >= 0.1
    guarded = X.proposal_menu(df, "n", "a", 3, guard=(2, 1.9)).first()
    assert (guarded["left"], guarded["right"]) == ("c", "c")


def test_a_round_limit_is_an_error(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a array<double>")
    with pytest.raises(NotConverged):
        P.frontier_weights(df, "id", "a", 4, rounds=1)
    with pytest.raises(NotConverged):
        P.capped_frontier(df, "id", "a", 4, rounds=1)


def test_stored_columns_start_the_next_solution(spark):
    rng = np.random.default_rng(12)
    values = rng.normal(size=(400, 4))
    old, new = columns(spark, values[:300]), columns(spark, values)
    first = P.frontier_weights(old, "id", "a", 4)
    cold = P.frontier_weights(new, "id", "a", 4)
    warm = P.frontier_weights(new, "id", "a", 4, start=first.pool(spark))
    gone = P.frontier_weights(new.filter("id % 2 = 0"), "id", "a", 4, start=first.pool(spark))  # half of the stored rows are gone
    assert warm.margin == pytest.approx(cold.margin, abs=1e-6) and warm.rounds <= cold.rounds
    assert gone.margin == pytest.approx(P.frontier_weights(new.filter("id % 2 = 0"), "id", "a", 4).margin, abs=1e-6)
    nominated = spark.createDataFrame([(3,), (7,)], "id bigint")
    assert P.frontier_weights(new, "id", "a", 4, start=nominated).margin == pytest.approx(cold.margin, abs=1e-6)


@pytest.mark.parametrize("floor", [0.05, 0.4, 1.0])
def test_levels_of_several_witnesses_in_the_same_passes(spark, floor):
    """Water levels by bins equal those found by bisection on the rows, ties and rows without moments included."""
    from winnow.operators import estimators as E

    rng = np.random.default_rng(6)
    p = rng.random(300)
    p /= p.sum()
    moments = rng.exponential(size=(300, 2)) ** 3
    moments[:40] = moments[0]
    moments[40:60] = 0
    df = spark.createDataFrame([(float(x), y.tolist()) for x, y in zip(p, moments)], "p double, A array<double>")
    witnesses = np.array([[0.5, 0.5], [1.0, 0.0], [0.1, 0.9]])
    for w, c in zip(witnesses, E._levels(df, witnesses, floor, 2)):
        b = p * np.sqrt(moments @ w)
        assert np.maximum(floor * p, c * b).sum() == pytest.approx(1.0, abs=1e-9)
