"""Byte-pair encoding, packing, personal data and the lattice model against plain versions."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from winnow.llm import bytepair, lattice, packing, personal
from winnow.llm.wordhash import span_hashes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARKS = "ab sS'tdmrevl\n\t 12é漢😀.,!\u0085 　²½ー’"


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randrange(50))) for _ in range(1500)]
    return [*texts, None, "", "'", "'s", "  ", "a  ", " 's", "it's  they'll've\n\n 'd", "x" * 5000, " " * 3000 + "a", "hello <|endoftext|> world", "ß" * 2000, "tie tie tie"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_decoding(docs, reference):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    want = collections.Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    got = bytepair.decode(bytepair.encode(docs(rows), RANKS), RANKS).collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes)) for r in got) == want
    empty = docs(rows[1:2]).limit(0)
    assert bytepair.decode(bytepair.encode(empty, RANKS), RANKS).collect() == []


def test_merging_many_equals_one(reference):
    with open(RANKS, "rb") as f:
        ranks = bytepair.read_ranks(f.read())
    rng = random.Random(2)
    words = [bytes(rng.choice(b"aabtheing \xc3\xa9e") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    many = bytepair.merge_many(words, ranks, bytepair.Pairs(ranks))
    assert [np.frombuffer(m, "<u4").tolist() for m in many] == [bytepair.merge(w, ranks) for w in words]


def test_cache_may_be_emptied(reference, monkeypatch):
    monkeypatch.setattr(bytepair, "CACHE", 5)
    with open(RANKS, "rb") as f:
        cache = bytepair.encoder(f.read())
    for t in ("some words and more words than fit", "other words", "some"):
        assert bytepair.encode_batch([t], cache)[0].tolist() == reference.encode_ordinary(t)


def test_packing(docs):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(odd_texts())] + [(9000, "the same " * 4000)] * 3
    tokenizer = Tokenizer.from_file(JSON)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows]
    got = packing.pack(docs(rows), JSON).collect()
    # every id once: pieces of a document follow each other in the stream
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    rebuilt, open_ = [], None
    for r in got:
        assert len(r.ids) == 4 * r.length
        if r.start == 0:
            open_ = [r.doc_id, b"", r.doc_tokens]
            rebuilt.append(open_)
        assert len(open_[1]) == 4 * r.start and open_[0] == r.doc_id
        open_[1] += bytes(r.ids)
    want = collections.Counter((i, x.tobytes(), len(x)) for (i, _), x in zip(rows, ids))
    assert collections.Counter(map(tuple, rebuilt)) == want
    lengths = []
    for _, group in itertools.groupby(got, key=lambda r: r.sequence_id):
        place = 0
        for r in group:
            assert r.offset == place
            place += r.length
        lengths.append(place)
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and sum(n != 2048 for n in lengths) <= 11
    assert sorted({r.sequence_id for r in got}) == list(range(len(lengths)))
    assert packing.pack(docs(rows[:1]).limit(0), JSON).collect() == []


def test_packing_lays_few_bytes_on_disk(docs, monkeypatch):
    """Ids lie compressed in the table and the shuffle that carry them."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("pre", "un", "over", "mis") for b in ("view", "done", "take", "lead", "cast")]
    kept, whole = [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda df: kept.append(whole(df)) or kept[-1])
    rows = [(i, " ".join(rng.choices(words, k=600))) for i in range(40)] + [(40, None), (41, "")]
    got = packing.pack(docs(rows), JSON).collect()
    tokenizer = Tokenizer.from_file(JSON)
    for i, text in rows:
        own = b"".join(r["ids"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(own, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
    held, n = kept[0].selectExpr("sum(length(ids))", "sum(n)").first()
    assert held < 0.75 * 2 * n


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_curve_steps_to_neighbours(bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=3)))
    keys = packing.hilbert(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_similar_documents_are_neighbours():
    a, b = np.arange(100, 400, dtype=np.uint32), np.arange(20_000, 20_300, dtype=np.uint32)
    near = [np.append(x[:290], np.uint32(7)) for x in (a, b)]
    k = packing.curve_keys([a, near[0], b, near[1]])
    assert abs(k[0] - k[1]) < abs(k[0] - k[2]) and abs(k[2] - k[3]) < abs(k[0] - k[2])


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def number_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789..@@+-- ()ab_é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    return texts + ["a@b.c@d.e", "x@y.z_w@q.com", "a@b@c.d", "é4111 1111 1111 1111 4111-1111-1111-1111é", "1.2.3.4.5.6.7.8", "0256.1.1.1", "00000255.0.0.1",
                    "9" * 20_000, "1." * 10_000, "+1" + "." * 5000, "@" * 500, "a" * 3000 + "@", "4" + "0" * 14 + "2"]


def test_base_spans_equal_the_patterns():
    for t in number_texts():
        assert personal.base_spans(t) == base_spans(t), t


def test_long_digits_take_linear_time():
    assert personal.base_spans("1" * 2_000_000) == [] and personal.base_spans("1.2." * 400_000)[:1] == [("ip", 0, 7)]


def test_find_and_redact(docs):
    cards = "4539578763621486 4916338506082832"  # two valid numbers that fail as one
    rows = [(i, f"filler {i} mail a{i}@host{i}.example.com card 4539578763621486, ip 10.0.{i % 250}.7 tel +1 (555) 555-01{i % 100:02d} end") for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, cards), (1003, "é" * 30_000 + f" {cards} " + "x" * 100_000), (1004, "clean text, 12 pages"), (1004, "clean text, 12 pages")]
    df = docs(rows)
    model = personal.train(df)
    got = {}
    for r in personal.find(df, model).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        base = base_spans(t or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in personal.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), int(s[1])))
    assert got[None].spans == "card:0:16,card:17:33" and got[1004].spans == ""
    redacted = personal.redact(df, model)
    assert redacted.columns == df.columns
    text = {r.doc_id: r.text for r in redacted.collect()}
    assert text[1000] is None and text[1001] == "" and text[None] == "[CARD] [CARD]" and text[1004] == "clean text, 12 pages"
    assert text[3] == "filler 3 mail [EMAIL] card [CARD], ip [IP] tel [PHONE] end"
    empty = df.limit(0)
    assert personal.find(empty, personal.train(empty)).collect() == []


def test_em_tells_labelers_apart():
    rng = np.random.default_rng(6)
    counts = collections.Counter()
    for _ in range(4000):
        real = rng.random() < 0.6
        votes = [rng.random() < (q if real else 1 - q) for q in (0.95, 0.99, 0.9)] + [None, rng.random() < (0.97 if real else 0.3)]
        counts["card " + "".join("0" if v is None else "+" if v else "-" for v in votes) + " 40"] += 1
    posterior, rates = personal.reliabilities(counts)
    assert rates["card"][0][0] > 0.85 > 0.3 > rates["card"][0][1]
    model = personal.fit(counts)
    assert model.chance["card +++0+ 40"] > 0.9 and model.chance["card ---0- 40"] < 0.1


def test_overlapping_spans_are_masked_once():
    assert personal.masked("abcdefgh", [("card", 1, 4), ("phone", 3, 6)]) == "a[CARD]gh"


def words_of(t):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))


def test_lattice_scores(docs):
    rng = random.Random(7)
    vocabulary = ["The", "the", "words", "größe", "漢字", "naïve", "antidisestablishment", "x" * 300, "it's", "É"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "unseen" * 20_000), (904, "tie"), (904, "tie")]
    df = docs(rows)
    got = lattice.score(df, PIECES).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [words_of(t) + [None] for _, t in rows]
    c = collections.Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # scores: one value a text, sums of its words' values and the end's
    one = {}
    for r, ws in ((r, t) for r in got for (i, _), t in zip(rows, tokens) if i == r.doc_id and i is not None):
        one.setdefault(tuple(sorted(map(str, ws))), set()).add(round(r.score, 6))
    assert all(r.score < 0 for r in got) and all(len(s) == 1 for s in one.values())
    assert lattice.score(df.limit(0), PIECES).collect() == []


def test_lattice_equals_all_segmentations():
    v = lattice.vocabulary(PIECES)
    logp = np.log(v.prior)
    number = dict(zip(v.hashes.tolist(), v.numbers.tolist()))

    def piece(b):
        return number.get(int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]))

    def every(s):
        if not s:
            yield []
        for k in range(1, min(len(s), v.longest) + 1):
            if (p := piece(s[:k])) is not None:
                yield from ([p, *rest] for rest in every(s[k:]))

    words = [b"the", b"cats", "ß".encode(), b"", b"undone"]
    got = lattice.log_probabilities(words, v, logp)
    uses, want = np.zeros(len(logp)), []
    for w in words:
        ways = [(math.prod(v.prior[p] for p in s), s) for s in every(b" " + w)]
        total = sum(x for x, _ in ways)
        want.append(math.log(total))
        for x, s in ways:
            np.add.at(uses, s, x / total)
    assert np.allclose(got, want)
    assert np.allclose(lattice.Lattices(words, v).expected(logp, np.ones(len(words))), uses)


def test_training_raises_the_likelihood():
    v = lattice.vocabulary(PIECES)
    words, counts = [b"alpha", b"alphabet", b"beta", b"betas"], np.array([5.0, 3, 9, 2])
    p, last = v.prior, -np.inf
    for _ in range(4):
        logp = np.log(np.maximum(p, 1e-300))
        value = float(counts @ lattice.log_probabilities(words, v, logp))
        assert value >= last - 1e-9
        last = value
        found = lattice.Lattices(words, v).expected(logp, counts)
        p = found / found.sum()
