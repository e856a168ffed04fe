"""Alignment of two tokenizers against plain loops over the libraries' tokens."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from winnow.llm import queries, tokenalign

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   two  blanks ", "plain words and plain words", "tab\tand\nline\r\n", "naïve café 北京 🎉🎉", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ is a sign", "x▁y", " non-breaking", "a", "0123456789" * 30, "plain words and plain words", "don't you'll we've", "zero\x00byte"]


def plain(rows):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    done, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in ids]
            for i in model.encode(text):
                piece = model.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
            want = b" " + text.encode()
            if b"".join(w for _, w in a) != want or b"".join(w for _, w in b) != want:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, w in side:
                out.append((i, at, at + len(w)))
                at += len(w)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        both = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = []
        for start, stop in zip([0, *both], both):
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= stop) for side in spans))
        count.update(set(links))
        done.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(((i, na, nb, ng, len(links), g, sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links))
                   for i, na, nb, ng, links, g in done), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 24 << 20])
def test_alignment(docs, monkeypatch, chunk):
    monkeypatch.setattr(tokenalign, "CHUNK_BYTES", chunk)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "plain words"), (None, None)]
    assert found(tokenalign.with_counts(tokenalign.align(docs(rows), A, B))) == plain(rows)


def test_empty_table_and_other_names(docs):
    assert tokenalign.with_counts(tokenalign.align(docs([(1, "x")]).limit(0), A, B)).collect() == []
    named = docs([(1, "some text")]).select(F.col("doc_id").alias("n_a"), F.col("text").alias("chunk"))
    (r,) = tokenalign.with_counts(tokenalign.align(named, A, B, text="chunk", doc_id="n_a")).collect()
    assert (r.doc_id, r.n_a, r.n_b, r.n_groups) == (1, 2, 2, 2)


def test_long_text(docs):
    """A text of some MB: sums over the whole, and every group spells the same bytes on both sides."""
    text = "Some words, and 12 more; ünd Wörter. " * 60_000
    (r,) = tokenalign.with_counts(tokenalign.align(docs([(1, text)]), A, B)).collect()
    groups = [g.split("|") for g in r.groups.split(";")]
    assert r.n_groups == len(groups) and r.n_a == sum(len(a.split(",")) for a, _ in groups) and r.count_sum == r.n_links


def test_batches_of_documents_do_not_touch():
    texts = [t for t in TEXTS if t and "▁" not in t]
    data = open(A, encoding="utf-8").read(), open(B, "rb").read()
    a, b = tokenalign.encode(texts, *data)
    ends = [np.cumsum(np.diff(t[2])[np.concatenate(ids)]) for t, ids in ((tokenalign._first(data[0]), a), (tokenalign._second(data[1]), b))]
    group_a, group_b = tokenalign.coalesce(*ends)
    stops = np.cumsum([len(x) for x in a])[:-1]
    assert (group_a[stops] != group_a[stops - 1]).all()
    assert sorted(set(group_a.tolist())) == sorted(set(group_b.tolist()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, na, nb, ng, nl, best, total, hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, nl, g, best, total in plain(rows)]
    got = queries.QUERIES["op12_tokenalign"](spark, sf)
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()), key=str) == want
