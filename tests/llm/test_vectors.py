"""Vector search and vector deduplication against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import hamming, multiindex

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("row", "score", "block", "class", "cell", "component"))])


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, *["x"] * 6) for i, v, y in rows], SCHEMA).repartition(3)


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


ODD = [None, [], [0.0] * 12, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11]


def sample_rows(n=500, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[40:60] = x[40]  # one vector many times
    x[60:120] = x[60] + 0.02 * rng.normal(size=(60, d))  # near copies
    x[120] = 3 * x[60]
    rows = [(i, x[i].tolist(), int(i % 3) if i < 40 or i >= 120 else 1) for i in range(n)]
    rows += [(n + i, v, 1) for i, v in enumerate(ODD)] + [(n + 50, x[60].tolist(), None), (7, x[7].tolist(), 7 % 3), (None, x[60].tolist(), 1)]
    return rows


@pytest.mark.parametrize("rows_per_block", [90, 8192])
def test_search(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(hamming, "ROWS", rows_per_block)
    monkeypatch.setattr(hamming, "QUERIES", 20)
    rows = sample_rows()
    got = {}
    for r in hamming.nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    known = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and good(v) and len(v) == 12]
    hits = total = 0
    for q, v in known:
        if q % 10:
            continue
        others = list(known)
        others.remove(next(x for x in others if x[0] == q))
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in others)[:10]
        mine = sorted(got.pop(q))
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(any(i == m[1] and abs(s - m[2]) < 1e-9 for s, i in ((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in others)) for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({i for _, i in want} & {m[1] for m in mine})
        total += 10
    assert not got and hits / total > 0.95


def test_copies_do_not_fill_the_sample(spark):
    """Copies of the vector that sorts first leave the radius, and so the recall of the others, as it is."""
    x = np.random.default_rng(8).normal(size=(400, 12))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    first = table(spark, rows).select("vec_id", F.xxhash64(F.col("embedding").cast("array<double>")).alias("h")).orderBy("h").first().vec_id
    rows += [(1000 + i, x[first].tolist(), 1) for i in range(300)]
    got = {}
    for r in hamming.nearest(table(spark, rows), (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 400), sample=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.array([r[0] for r in rows])
    all_ = np.array([r[1] for r in rows], np.float32).astype(float)
    hits = []
    for q, found in got.items():
        d = np.sqrt(((all_ - all_[q]) ** 2).sum(1))
        order = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        hits.append(len(found & set(order)) / 10)
    assert len(got) == 40 and np.mean(hits) > 0.95


def test_search_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (100, [1.0, 0.0], 1), (200, None, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in hamming.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 5), (100, 1, 0), (100, 2, 5)]
    assert hamming.nearest(table(spark, rows[:1]), F.col("vec_id") % 100 == 0).collect() == []
    assert hamming.nearest(table(spark, rows).limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    bits = rng.random((400, 37)) < 0.5
    for parts in (1, 3, 8):
        index = hamming.Index(bits, parts)
        for radius in (0, 2, 5, 11, 18, 37):
            code = bits[5] ^ (rng.random(37) < 0.2)
            assert index.within(code, radius).tolist() == np.flatnonzero((bits ^ code).sum(1) <= radius).tolist()


def brute(rows, least=0.98):
    keys = [(v is not None and good(v) and y is not None, y, None if not good(v) else np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))) for _, v, y in rows]
    n, label = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            (ga, ya, va), (gb, yb, vb) = keys[a], keys[b]
            if ga and gb and ya == yb and len(va) == len(vb) and va @ vb >= least:
                n[a] += 1
                n[b] += 1
                label[find(a)] = find(b)
    name = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(name.get(find(k), i), i)
    return sorted(((i, n[k], name.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [13, 1024])
@pytest.mark.parametrize("centres", [None, 5])
def test_deduplication(spark, monkeypatch, block, centres):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    rows = sample_rows(seed=3)
    got = multiindex.near_duplicates(table(spark, rows), centres=centres).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id if r.component_id is not None else True) for r in got)


def test_deduplication_edges(spark):
    rows = [(3, [2.0], 1), (4, [5.0], 1), (5, [-1.0], 1), (6, [1e-30, 1e-30], 1), (7, [1e30, 1e30], 1), (None, [0.0, 1.0], 2), (None, [0.0, 1.0], 2)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in multiindex.near_duplicates(table(spark, rows)).collect()}
    assert got == {(3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 1, None, True)}
    assert multiindex.near_duplicates(table(spark, rows).limit(0)).collect() == []


def test_no_cell_with_a_near_vector_is_skipped():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = multiindex.codebook(x[:, :4], 7), multiindex.codebook(x[:, 4:], 7)
    (h1, l1), (h2, l2) = multiindex.bounds(x[:, :4], books[0]), multiindex.bounds(x[:, 4:], books[1])
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(0, 600, 7):
        met = multiindex.visits(l1[i], l2[i], 0.3)
        low = l1[i][met // 7] + l2[i][met % 7]
        assert (np.diff(low) >= 0).all()
        assert set((h1 * 7 + h2)[far[i] <= 0.3].tolist()) <= set(met.tolist())
