"""Near-duplicates against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import common, minhash
from winnow.llm.common import components
from winnow.llm.wordhash import shingle_sets, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if x == old else x for x in label]
                    changed = True
        if not changed:
            break
    name = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            name[c] = min(name.get(c, i), i)
    return sorted(((i, len(s), i if not s else name.get(c)) for (i, _), s, c in zip(rows, sets, label)), key=str)


def table():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "TWO  words"), (8, "É one"), (9, "é one"), (None, "lost words here now"),
            (None, "lost words here now"), (10, "null friend of many words"), (None, "null friend of many words"), (11, "repeated row"), (11, "repeated row")]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(60):  # a group of copies with zero to nine changed words
        own = list(base)
        for _ in range(i % 10):
            own[rng.randrange(150)] = rng.choice(words)
        rows.append((100 + i, " ".join(own)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    long = [rng.choice(words) for _ in range(30_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:-1000])), (502, "x" * 200_000), (503, "X" * 200_000)]
    return rows


def test_equals_all_pairs(docs):
    rows = table()
    for k, num in ((3, 85), (5, 80)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), k, num, 100).collect()]
        assert sorted(got, key=str) == brute(rows, k, num, 100)


def test_blocks_of_a_hot_group(docs, monkeypatch):
    """The same groups when buckets and groups are cut into many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    rows = table()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), 3, 85, 100).collect()]
    assert sorted(got, key=str) == brute(rows, 3, 85, 100)


def test_bundles_of_a_hot_group_stay_small(docs, monkeypatch):
    """The number of bundles follows the rows of the grid, which grow with the square of a bucket."""
    bundle, seen = minhash._bundle, []

    def watched(rows, key, weight, *more):
        seen.append((key, weight, rows.agg(F.sum("n" if "shingles" in rows.columns else F.lit(1))).first()[0]))
        return bundle(rows, key, weight, *more)

    monkeypatch.setattr(minhash, "_bundle", watched)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(60)]
    assert {r.component_id for r in minhash.near_duplicates(docs(rows)).collect()} == {0}
    assert {key for key, _, _ in seen} == {"key"} and all(weight == size for _, weight, size in seen)
    seen.clear()
    rng = np.random.default_rng(6)  # a chain: neighbours are similar, so that most spanning edges are no links
    rows = [(i, " ".join(f"c{j}" for j in range(9 * i, 9 * i + 150))) for i in rng.permutation(40).tolist()]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: c for i, _, c in brute(rows, 5, 80, 100)} and set(got.values()) == {0}
    assert [key for key, _, _ in seen] == ["key", "key", "component"] and all(weight == size for _, weight, size in seen)


def test_sets_travel_about_once(docs, monkeypatch):
    """In a large group of near copies a set meets few others, however many blocks the group would have."""
    along, grid, moved = minhash._along, minhash._part_grid, []

    def watched(edges, sets, *more):
        moved.append(edges.count())
        return along(edges, sets, *more)

    def dealt(rows):
        out = grid(rows)
        moved.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_along", watched)
    monkeypatch.setattr(minhash, "_part_grid", dealt)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "STAR_SHINGLES", 3000)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)
    assert sum(moved) < 7 * len(rows)  # all blocks with all would be 15 a set


def test_survivors(docs):
    rows = table()
    df = docs(rows)
    left = minhash.survivors(df)
    assert left.columns == df.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    groups = {}
    for i, n, c in brute(rows, 5, 80, 100):
        if n:
            groups.setdefault(c, []).append(i)  # one group here has null ids alone
    want = [min((i for i in g if i is not None), default=None) for g in groups.values()] + [1, 2, 3]
    assert sorted(str(i) for i, _ in got) == sorted(map(str, want)) and (None, "lost words here now") in got


def shuffled(df, column):
    """Rows that the exchanges of df's plan dealt out with a column of that name, once df ran."""
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        below = plan.children()
        plans += [below.apply(i) for i in range(below.size())]
        if kind == "ShuffleExchangeExec" and re.search(rf"\b{column}#", plan.output().mkString(",")):
            total += plan.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_texts_of_copies_stay_where_they_are(spark, docs):
    """What goes is told by ids and hashes; where nothing is small enough to broadcast, its texts do not travel to be dropped."""
    rows = [(i, " ".join(f"g{i % 20}w{k}" for k in range(30))) for i in range(200)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.survivors(docs(rows).localCheckpoint())
        assert sorted(r.doc_id for r in left.collect()) == list(range(20))
        assert shuffled(left, "text") <= 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_band_keys_travel_short(spark, docs, monkeypatch):
    """Most keys have one class alone, so a class travels with its keys as one number."""
    seen, cut = [], minhash.cut

    def watched(df, *more):
        out = cut(df, *more)
        if "key" in df.columns and "size" in df.columns:
            seen.append(dict(df.dtypes))
        return out

    monkeypatch.setattr(minhash, "cut", watched)
    rows = [(i, " ".join(f"g{i % 20}w{k}" for k in range(30 + i // 20))) for i in range(100)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)
    assert seen and all(t == "bigint" for t in seen[0].values())


def test_empty_table(docs):
    empty = docs([(1, "a")]).limit(0)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.survivors(empty).collect() == []


def test_registers_are_mergeable_and_truncated():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, 5000, np.uint64)) for _ in range(2))
    sa, sb, sab = minhash.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(sa, sb) == sab).all()
    assert (minhash.sketches([np.zeros(0, np.uint64)]) == 0).all() and sab.max() <= minhash.TOP + 1


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        common = rng.integers(0, 1 << 63, int(2 * n * j / (1 + j)), np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), np.uint64)])) for _ in range(2)]
        x, y = minhash.sketches(own)
        grid = np.linspace(0.01, 0.999, 200)
        at = grid[np.argmax(minhash.log_likelihood(grid, 0.5, (x > y).sum(), (x < y).sum(), (x == y).sum()))]
        assert abs(at - j) < 0.15
        assert minhash.possible(x[None], y[None], np.array([n]), np.array([n]), j - 0.01)[0][0, 0]


def test_word_hashes_do_not_depend_on_place():
    words, at = word_hashes([b"Alpha beta", b"", b"  beta\talpha  "])
    assert at.tolist() == [0, 2, 2, 4] and words[0] == words[3] and words[1] == words[2] and words[0] != words[1]
    assert [len(s) for s in shingle_sets([b"a b c a b c", b"a b", b""], 3)] == [3, 1, 0]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == set(range(61)) | {100, 101}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] and got[0] != got[100]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("bits", [1 << 15, 1 << 24])
def test_sieve_passes_every_member(spark, monkeypatch, bits):
    """No member is lost, whatever the size; a sieve much larger than its members stops most others."""
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    rows = spark.range(0, 5000).select(F.col("id").alias("at"), F.lit("x").alias("page"), F.lit("y").alias("bit"))
    got = common.with_maybe(rows, "at", common.sieve(spark.range(0, 5000, 10), "id"), "maybe")
    passed = {r.at for r in got.where("maybe").collect()}
    assert got.count() == 5000 and got.columns == ["at", "page", "bit", "maybe"]
    assert set(range(0, 5000, 10)) <= passed and len(passed) < 500 + (100 if bits > 1 << 20 else 400)
    assert common.with_maybe(rows, "at", common.sieve(spark.range(0), "id"), "maybe").where("maybe").isEmpty()
