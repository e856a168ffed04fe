"""The corpus pipeline, stage by stage and as a whole, over documents with planted cases."""

import collections
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from winnow.llm import packing, toxicity
from winnow.llm.common import cut

SAMPLE = "/root/testdata/sf0.01"
EXTRA = ("score", "at", "row", "digest", "toxicity", "component", "order", "key")  # names that stages use inside
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in EXTRA)])
FOREIGN = "數據處理是一項重要的工作，我們需要仔細檢查每一個文件。今天天氣很好，大家都去公園散步了。"
PERSONAL = "Please write to jane.doe@example.org or call +44 20 7946 0958 from 192.168.10.77 about card 4111 1111 1111 1111 soon."
BASE = 900_000


def planted(sample, english, toxic):
    """(doc_id, text) by kind of case."""
    rng = np.random.default_rng(3)
    clean = next(t for t in sample if t and len(t.split()) > 150)
    words = clean.split()
    near = list(words)
    near[len(near) // 2] = "changedword"
    long = " ".join(" ".join(english[i].split()) for i in rng.integers(0, len(english), 400))[:600_000]
    return {
        "toxic": [(BASE + i, t) for i, t in enumerate(toxic[:3])],
        "foreign": [(BASE + 10, FOREIGN * 8), (BASE + 11, FOREIGN[::-1] * 9)],
        "copies": [(BASE + 20, clean), (BASE + 21, clean.upper()), (BASE + 22, " ".join(near))],
        "personal": [(BASE + 30, " ".join(words[10:80]) + " " + PERSONAL)],
        "odd": [(BASE + 40, None), (BASE + 41, ""), (BASE + 42, " \n\t"), (None, " ".join(words[20:140]) + " nobody"), (BASE + 43, "1234 5678")],
        "repeated": [(BASE + 50, " ".join(words[5:120]) + " twice")] * 2,
        "long": [(BASE + 60, long)],
    }


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents with the planted cases and their labels, and what was planted."""
    rows = spark.read.parquet(f"{SAMPLE}/documents.parquet").filter("doc_id < 400").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    toxic = [r.text for r in rows if labels.get(r.doc_id) == 1]
    cases = planted([r.text for r in rows], [r.text for r in rows if r.lang == "en" and labels.get(r.doc_id) == 0], toxic)
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *["x"] * len(EXTRA)) for r in rows]
    data += [(i, t, None, "planted", None if t is None else len(t), *["x"] * len(EXTRA)) for own in cases.values() for i, t in own]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SAMPLE}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, cases, labels


@pytest.fixture(scope="module")
def stages(spark, corpus):
    """The input and output of every stage."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, corpus[0]))
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "language", "near_duplicates", "personal_data", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in DOCS]
            if name != "personal_data":  # a filter: rows stay as they are
                assert after.exceptAll(before).isEmpty()


def test_toxic_documents_go(spark, corpus, stages):
    folder, cases, labels = corpus
    before, after = stages["toxicity"]
    scored = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert ids(after) == collections.Counter(r.doc_id for r in scored if r.predicted == 0)
    left = ids(after)
    bad = [i for i, y in labels.items() if y == 1 and i < 400] + [i for i, _ in cases["toxic"]]
    assert sum(left[i] == 0 for i in bad) / len(bad) > 0.4  # few labels here; accuracy is tested on more in test_classifiers
    assert all(left[i] for kind in ("copies", "personal", "odd", "repeated", "long") for i, _ in cases[kind])
    clean = [i for i, y in labels.items() if y == 0 and i < 400]
    assert sum(left[i] > 0 for i in clean) / len(clean) > 0.99


def test_foreign_documents_go(corpus, stages):
    _, cases, _ = corpus
    before, after = stages["language"]
    left = ids(after)
    assert not any(left[i] for i, _ in cases["foreign"]) and not any(left[i] for i in (BASE + 40, BASE + 41, BASE + 42, BASE + 43))
    known = ids(before.filter("lang is not null"))
    assert sum(left[i] > 0 for i in known) / len(known) > 0.99
    assert all(left[i] for kind in ("copies", "repeated", "long") for i, _ in cases[kind]) and left[None] == 1


def test_one_of_every_group_stays(corpus, stages):
    _, cases, _ = corpus
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect() if r.doc_id != BASE + 60]
    groups = collections.defaultdict(list)
    for i, n, c in brute(rows, 5, 80, 100):
        groups[c].append(i)
    want = collections.Counter(min((i for i in g if i is not None), default=None) for g in groups.values()) + collections.Counter([BASE + 60])
    assert ids(after) == want
    assert sum(want[i] for i, _ in cases["copies"]) <= 1 and want[BASE + 50] == 1


def test_personal_data_is_masked(corpus, stages):
    _, cases, _ = corpus
    before, after = stages["personal_data"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    text = new[BASE + 30].text
    for secret in ("jane.doe@example.org", "+44 20 7946 0958", "192.168.10.77", "4111 1111 1111 1111"):
        assert secret not in text
    assert text.split()[:60] == cases["personal"][0][1].split()[:60] and text.endswith("soon.")
    for i, row in new.items():
        assert row.n_chars == len(row.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", row.text)
        words, before_ = collections.Counter(row.text.split()), collections.Counter(old[i].text.split())
        assert (words & before_).total() > 0.6 * before_.total() - 3


def test_packing_keeps_every_token(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter(np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [packing.END], "<u4").tobytes() for r in before.select("text").collect())
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(int)
    for r in sorted(after.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences[r.sequence_id] and len(r.ids) == 4 * r.length
        sequences[r.sequence_id] += r.length
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    got = collections.Counter(b"".join(p for _, p in sorted(own)) for own in pieces.values())
    assert got == want and all(n in (2048, *(1 << b for b in range(11))) for n in sequences.values())


def test_run_is_its_stages(spark, corpus, stages):
    got = corpus_pipeline.run(spark, corpus[0])
    key = lambda df: collections.Counter((r.doc_id, r.start, bytes(r.ids)) for r in df.collect())
    assert key(got) == key(stages["packing"][1])


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_labels_and_one_document(spark, corpus, tmp_path):
    spark.createDataFrame([(1, "Some words that stand alone, and nothing else.", "en", "s", 46, *["x"] * len(EXTRA))], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus[0]}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens and {r.doc_id for r in rows} == {1}
    assert rows[0].doc_id == 1
