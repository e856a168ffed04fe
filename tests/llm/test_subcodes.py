"""Vector codes against plain rounds over all entries."""

import numpy as np
import pytest
from pyspark.sql import types as T

from winnow.llm import subcodes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("code", "error", "x", "part", "n", "entry"))])


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, *["x"] * 6) for i, v, y in rows], SCHEMA).repartition(3)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    good = [(i, [int(np.floor(scale * np.float64(np.float32(c)))) for c in v], y) for i, v, y in rows
            if v and all(c is not None and np.isfinite(c) and abs(c) < 32768 for c in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    x = np.array([r[1] for r in good], object)
    code, error, books = np.zeros((len(x), parts), int), np.zeros(len(x), object), []
    for p, (a, b) in enumerate(subcodes.cuts(x.shape[1], parts)):
        own = x[:, a:b]
        book = [e.copy() for e in own[:entries]]
        for t in range(rounds + 1):
            far = [[int(((v - e) ** 2).sum()) for e in book] for v in own]
            code[:, p] = [min(range(len(book)), key=lambda e: (f[e], e)) for f in far]
            if t < rounds:
                for e in set(code[:, p].tolist()):
                    mine = own[code[:, p] == e]
                    book[e] = np.array([int(s) // len(mine) for s in mine.sum(0)], object)
        error = error + np.array([f[c] for f, c in zip(far, code[:, p])], object)
        books.append(book)
    return sorted(((r[0], r[2], bytes(c.tolist()).hex(), int(e)) for r, c, e in zip(good, code, error)), key=str), books


def found(spark, rows, **options):
    coded, books = subcodes.fit(table(spark, rows), **options)
    return sorted(((r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()), key=str), books


def same(books, other):
    return [[[int(v) for v in e] for e in b] for b in books] == [[[int(v) for v in e] for e in b] for b in other]


ODD = [None, [], [1.0] * 9 + [None], [float("nan")] + [1.0] * 9, [float("-inf")] + [0.0] * 9, [0.0] * 10, [1.0] * 8, [40000.0] * 10, [-0.0001] * 10, [30000.0] * 10]


@pytest.mark.parametrize("entries, rounds", [(256, 4), (7, 4), (1, 2), (5, 0)])
def test_codes(spark, entries, rounds):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 10))
    x[20:60] = x[20]  # ties and entries without parts
    rows = [(i, v.tolist(), int(i % 3) if i % 5 else None) for i, v in enumerate(x)]
    rows += [(500 + i, v, 1) for i, v in enumerate(ODD)] + [(3, x[9].tolist(), 1), (3, x[3].tolist(), 0), (None, x[70].tolist(), 2)]
    got, books = found(spark, rows, entries=entries, rounds=rounds)
    want, other = plain(rows, entries=entries, rounds=rounds)
    assert got == want and same(books, other)


def test_few_rows(spark):
    assert found(spark, [])[0] == [] and subcodes.spell_codebooks(found(spark, [(1, None, 1)])[1]) == ""
    got, books = found(spark, [(2, [0.5, -0.5, 1.0, 2.0], 1), (1, [1.0] * 3, None)])
    want, other = plain([(2, [0.5, -0.5, 1.0, 2.0], 1), (1, [1.0] * 3, None)])
    assert got == want and same(books, other)
    with pytest.raises(ValueError, match="257"):
        subcodes.fit(table(spark, [(1, [1.0], 1)]), entries=257)


@pytest.mark.parametrize("scale", [40, 1 << 24])
def test_bounds_leave_the_nearest_entry(scale):
    """Over many rounds every code equals a full scan, ties to the lower index, and most entries are not scanned again."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    x = np.floor(scale * (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 6)))).astype(np.int64)
    history = [x[:64].copy()]
    groups = subcodes.entry_groups(history[0])
    assert sorted(np.concatenate(groups).tolist()) == list(range(64))
    scanned = []
    for t in range(9):
        work = subcodes.Bounded(history, groups)
        state = work.first(x) if t == 0 else work.again(x, state[0], state[2], state[3])
        far = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (state[0] == far.argmin(1)).all() and (state[1] == far.min(1)).all()
        scanned.append(work.rescanned / far.size)
        new = history[-1].copy()
        for e in np.unique(state[0]):
            mine = x[state[0] == e]
            new[e] = mine.sum(0) // len(mine)
        history.append(new)
    assert max(scanned[5:]) < 0.5


def test_net_movement_is_what_a_bound_loses():
    """An entry that moves away and comes back costs nothing, although it drifted."""
    c = np.array([[0, 0], [1000, 0], [0, 1000]])
    away = c.copy()
    away[1] = [600, 300]
    x = np.array([[10, 10], [-20, 5]])
    groups = [np.array([0]), np.array([1]), np.array([2])]
    state = subcodes.Bounded([c], groups).first(x)
    work = subcodes.Bounded([c, away, c], groups)
    work.again(x, state[0], state[2], state[3])
    assert work.rescanned == 0


def test_label_errors(spark):
    rows = [(i, [float(i), 1.0, -2.0, 0.3], [None, 1, 2][i % 3]) for i in range(30)]
    coded, _ = subcodes.fit(table(spark, rows), entries=4)
    got = subcodes.label_errors(coded).collect()
    total = {}
    for r in got:
        total[r.label] = total.get(r.label, 0) + r.error
    assert len(got) == 30 and all(r.label_error == total[r.label] for r in got)
