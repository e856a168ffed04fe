"""Prefix trees of conversations against plain reading."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from winnow.llm import chattree, queries
from winnow.llm.bytepair import decode_ids

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DATA = open(PATH, "rb").read()
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *(T.StructField(n, T.StringType()) for n in ("key", "node", "run", "tree", "start", "depth", "content"))])
TOLD = "<|im_end|><|im_start|>assistant ok"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3)


def conversations(rows):
    """The turns of every conversation as (role, text), in order."""
    content = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1] is not None, r[1] or 0, content(r), r[2] or "", r[3] or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in by.items()}


def plain(rows):
    out = []
    for c, turns in conversations(rows).items():
        said = [t for r, t in turns if r == "assistant"]
        formatted = "".join(f"<|im_start|>{chattree.escape_role(r)}\n{chattree.escape(t)}<|im_end|>\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len("".join(said)),
                    hashlib.sha256("".join(said).encode()).hexdigest(), len(formatted)))
    return sorted(out, key=str)


def read(trees):
    return sorted((tuple(r) for r in chattree.read_back(trees, PATH).collect()), key=str)


def spell(ids):
    """Ids as text with the marks."""
    top = len(chattree.vocabulary(DATA)[1]) - 1
    out, own = [], []
    for i in [*ids, None]:
        if i is None or i >= top:
            out.append(decode_ids(np.array(own, "<u4").tobytes(), DATA).decode())
            own = []
            if i is not None:
                out.append((chattree.START, chattree.END)[i - top])
        else:
            own.append(i)
    return "".join(out)


def check_trees(trees, rows):
    """Every beginning once, subtrees in one piece, and what a conversation's last turn sees is that conversation."""
    told = conversations(rows)
    beginnings = {tuple(turns[: i + 1]) for turns in told.values() for i in range(len(turns))}
    nodes = [r.asDict() for r in trees.nodes.collect()]
    assert len(nodes) == len(beginnings)
    assert [(n["tree"], n["start"]) for n in nodes] == sorted((n["tree"], n["start"]) for n in nodes)
    assert len({n["tree"] for n in nodes}) == len({b for b in beginnings if len(b) == 1})
    streams, ids = collections.defaultdict(int), collections.defaultdict(list)
    for n in nodes:
        own = np.frombuffer(n["ids"], "<u4").tolist()
        assert n["start"] == streams[n["tree"]] and n["n_tokens"] == len(own)
        streams[n["tree"]] += len(own)
        ids[n["tree"]] += own
    runs = {r.run: r for r in trees.runs.collect()}
    at = {(n["tree"], n["start"]): n for n in nodes}
    paths = collections.defaultdict(list)
    for r in trees.turns.collect():
        paths[r.conv_id].append((r.depth, at[r.tree, r.start]))
    spans = collections.defaultdict(list)
    for c, path in paths.items():
        path.sort(key=lambda p: p[0])
        assert [d for d, _ in path] == list(range(1, len(path) + 1))
        seen = 0
        for d, n in path:
            assert n["depth"] == d and n["position"] == seen
            seen += n["n_tokens"]
            spans[tuple(told[c][:d])].append((n["tree"], n["start"], n["start"] + n["n_tokens"]))
        last, run = path[-1][1], runs[path[-1][1]["run"]]
        view = [*((i["start"], i["stop"]) for i in run.ancestors), (run.start, last["start"] + last["n_tokens"])]
        assert all(a < b for a, b in view) and all(x[1] < y[0] for x, y in zip(view[:-1], view[1:-1]))
        assert run.position == sum(b - a for a, b in view[:-1])
        tokens = [t for a, b in view for t in ids[last["tree"]][a:b]]
        assert spell(tokens) == "".join(f"<|im_start|>{chattree.escape_role(r)}\n{chattree.escape(t)}<|im_end|>\n" for r, t in told[c])
    for beginning, own in spans.items():  # depth first: what follows a node is together, right after it
        assert len(set(own)) == 1
        below = sorted({s[0] for other, s in spans.items() if other[: len(beginning)] == beginning}, key=lambda s: s[1])
        assert below[0] == own[0] and all(x[2] == y[1] for x, y in zip(below, below[1:]))


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "less"), (2, 3, "assistant", ""),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi"),
    (4, 0, "user", "hello"), (4, 1, "assistant", "hi"), (4, 2, "user", "more"), (4, 3, "assistant", "yes"),
    (5, 0, "user", TOLD), (5, 1, "assistant", TOLD), (5, 2, "assistant", TOLD),
    (6, 0, "system", None), (6, 1, None, "no role"), (6, 1, "user", "same turn"), (6, 1, "user", "same turn"), (6, None, "assistant", "first"),
    (None, 0, "user", "hello"), (None, 5, "assistant", "nobody's <\\| <\\\\|x"), (7, 9, "two\nlines\\n<|im_start|>", "\n\n"),
    (8, 0, "user", "hello"), (8, 1, "assistant", "hi"), (8, 2, "user", "more"), (8, 3, "user", "other"), (8, 4, "user", "x"),
    (9, 0, "assistant", "grüße 北京 🎉"), (-1, 0, "user", TOLD), (-1, 1, "assistant", TOLD)]


@pytest.mark.parametrize("block", [4096, 2, 1])
def test_trees(spark, monkeypatch, block):
    monkeypatch.setattr(chattree, "BLOCK", block)
    trees = chattree.grow(table(spark, ROWS), PATH)
    check_trees(trees, ROWS)
    assert read(trees) == plain(ROWS)


def test_many_branches(spark):
    """Random conversations over few texts, a comb of conversations that leave one path at every depth, and many copies."""
    rng = np.random.default_rng(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", str(x)) for c in range(60) for t, x in enumerate(rng.integers(0, 2, rng.integers(1, 7)))]
    rows += [(100 + c, t, "user", f"turn {t}" if t < c or c == 25 else f"leaves at {c}") for c in range(26) for t in range(min(c + 1, 25))]
    rows += [(200 + c, t, "user", "copy") for c in range(50) for t in range(3)]
    trees = chattree.grow(table(spark, rows), PATH)
    check_trees(trees, rows)
    assert read(trees) == plain(rows)


def test_hot_tree_and_conversation(spark, hot):
    rows = [(1, t, "user", f"turn {t}") for t in range(40)] + [(c, t, "user", f"turn {t}" if t < 3 else f"own {c}") for c in range(2, 20) for t in range(5)]
    trees = chattree.grow(table(spark, rows), PATH)
    check_trees(trees, rows)
    assert read(trees) == plain(rows)


def test_long_and_empty(spark):
    long = [(1, 0, "user", "a long text, " * 120_000), (1, 1, "assistant", "b" * 300_000), (2, 0, "user", ""), (2, 1, "assistant", None)]
    assert read(chattree.grow(table(spark, long), PATH)) == plain(long)
    none = chattree.grow(table(spark, long).limit(0), PATH)
    assert read(none) == [] and none.nodes.count() == none.runs.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\ni_a\n", max_size=12))
def test_escapes_come_back(text):
    assert chattree.unescape(chattree.escape(text)) == text and "<|" not in chattree.escape(text)
    role = chattree.escape_role(text)
    assert chattree.unescape_role(role) == text and "\n" not in role and "<|" not in role


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_chattree"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([*rows, (-1, 0, "user", TOLD), (-1, 1, "assistant", TOLD)])
