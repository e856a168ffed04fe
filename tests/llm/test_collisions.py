"""Words whose polynomial hashes agree modulo 2^64 are still different words, in every operator that reads words."""

import collections
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from winnow.llm import bytepair, lattice, minhash, packing, wordhash
from test_texts import JSON, PIECES, RANKS, reference  # noqa: F401

FLIP = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(FLIP)
    return word


ONE = thue_morse(1024)
OTHER = ONE.translate(FLIP)


@pytest.fixture(params=["as is", "every hash equal"])
def weak(request, monkeypatch):
    """The second case makes all words collide, so that only their bytes can tell them apart."""
    if request.param != "as is":
        flat = lambda buffer, starts, *_, **__: np.zeros(len(starts), np.uint64)
        monkeypatch.setattr(wordhash, "span_hashes", flat)
        monkeypatch.setattr(bytepair, "span_hashes", flat)


def test_the_pair_collides_as_polynomials():
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(wordhash.short_hashes(data, starts, ends).tolist())) == 1
    assert len(set(wordhash.span_hashes(data, starts, ends).tolist())) == 2


def test_byte_pairs(weak, reference):  # noqa: F811
    with open(RANKS, "rb") as f:
        data = f.read()
    cache = bytepair.encoder(data)
    texts = [ONE, OTHER, f"{ONE} {OTHER}", "short words and short words"]
    got = bytepair.encode_batch(texts, cache)
    assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [bytepair.decode_ids(g.tobytes(), data).decode() for g in got] == texts


def test_packing(weak):
    tokenizer = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as f:
        data = f.read()
    got = packing.token_ids([ONE, OTHER], data)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids + [packing.END] for t in (ONE, OTHER)]


def test_lattice_counts(docs):
    rows = [(1, ONE), (2, OTHER), (3, ONE)]
    got = {r.doc_id: r for r in lattice.score(docs(rows), PIECES).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(train)
    n, v = 2 * len(train), len(c) + 1
    for i, t in rows:
        want = math.log10((c[t] + 1) / (n + v + 1)) + math.log10((len(train) + 1) / (n + v + 1))
        assert abs(got[i].base_score - want) < 1e-12


def test_lattice_words_with_equal_hashes(weak):
    import pyarrow as pa

    chunk = lattice._Chunk(0)
    texts = ["one two one", "two three " + ONE, OTHER]
    for i in (0, 2):
        part = texts[i : i + 2]
        chunk.add(pa.RecordBatch.from_pydict({"doc_id": list(range(len(part))), "text": part, "held_out": [False] * len(part)}))
    words, inverse = chunk.distinct()
    assert [words[i].decode() for i in inverse] == " ".join(texts).split() and len(set(words)) == len(words)


def test_shingles(docs):
    one, other = wordhash.shingle_sets([ONE.encode(), OTHER.encode()], 3)
    assert one.tolist() != other.tolist()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs([(1, ONE), (2, OTHER), (3, ONE)]), k=3, num=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("window", [1, 5, 1 << 18])
def test_spans_are_compared_whole(window):
    data = np.frombuffer(b"abcabcabdxxxxxxxxxxxxxxxxy", np.uint8)
    starts, ends = np.array([0, 3, 9, 9]), np.array([3, 6, 9, 17])
    assert wordhash.same_spans(data, starts, ends, data, np.array([3, 0, 2, 17 - 8]), np.array([6, 3, 2, 17]), window)
    assert not wordhash.same_spans(data, starts, ends, data, np.array([3, 6, 2, 9]), np.array([6, 9, 2, 17]), window)
    assert not wordhash.same_spans(data, starts, ends, data, np.array([3, 0, 2, 18]), np.array([6, 3, 2, 26]), window)
    assert not wordhash.same_spans(data, starts, ends, data, np.array([3, 0, 2, 9]), np.array([6, 3, 3, 17]), window)
