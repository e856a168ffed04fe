"""Document probability under a subword lattice.

The vocabulary and its scores exist already: the pieces of a tokenizer model, of which the score's rank gives a prior. A text is a
sequence of words, each a blank and its bytes, then an end. Every way to cut it into pieces counts: the probability of
the text is the sum over all of them, found by a forward recursion in log space. No piece reaches over a blank, so the
recursion factors at word starts and is run once for every distinct word.

Piece probabilities are fitted by expectation-maximisation: expected piece counts over all words of the training documents,
weighted by how often they occur, added to the prior. Word counts are one aggregate over the corpus. Documents never meet the
word table: a chunk of documents ships its distinct words once and gets their counts and log probabilities back.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, held_out, pieces, prepare, spread, texts
from winnow.llm.wordhash import inverse_powers, mix, prefix_sums, same_spans, short_hashes, word_spans
from winnow.plans.partials import array_sum

CHUNK = 16 << 20  # bytes of text whose distinct words are shipped together
CHUNK_BITS, NUMBER_BITS = 13, 27  # of a place: chunks of a task, words of a chunk
ROUNDS = 2
PRIOR = 1000.0  # how many pieces the existing scores count for
WORDS = 20_000  # words a recursion


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the pieces, sorted, with the pieces' numbers; prior probabilities by number, the end last; longest piece."""

    hashes: np.ndarray
    numbers: np.ndarray
    prior: np.ndarray
    longest: int


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model as bytes, a leading blank for the word mark; all single bytes are pieces.

    The prior of a piece falls with the rank of its score (one over rank and a constant); pieces of several blanks and control
    symbols are left out. Every size here is bounded by the vocabulary.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        if byte:
            score.setdefault(bytes([int(byte[1], 16)]), -1e8)
        elif not (model.is_control(i) or model.is_unknown(i)):
            word = piece.replace("▁", " ").encode()
            if b" " not in word[1:]:
                score[word] = max(score.get(word, -np.inf), model.get_score(i))
    for b in range(256):
        score.setdefault(bytes([b]), -1e8)
    words = sorted(score, key=lambda w: (-score[w], w))
    weight = 1 / (np.arange(len(words) + 1) + 30.0)
    weight[-1] = weight[100]  # the end
    ends = np.cumsum([len(w) for w in words])
    hashes = short_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int32), weight / weight.sum(), max(map(len, words)))


class Lattices:
    """The lattices of some words: for every way to end a piece, its start, end and piece, in the order of the recursion."""

    def __init__(self, words: list[bytes], v: Vocabulary):
        size = np.array([len(w) + 1 for w in words])
        buffer = np.frombuffer(b"".join([b" " + w for w in words]), np.uint8)
        n = len(buffer)
        self.last = np.cumsum(size) + np.arange(len(words))  # nodes: one before every byte and one after every word
        self.first = self.last - size
        self.nodes = n + len(words)
        word = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)[word]
        sums, inverse = prefix_sums(buffer), inverse_powers(n + 1)
        start, end, piece = [], [], []
        at = np.arange(n)
        for length in range(1, v.longest + 1):
            at = at[at + length <= stop[at]]
            if not len(at):
                break
            h = mix((sums[at + length] - sums[at]) * inverse[at])
            k = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            hit = v.hashes[k] == h
            own = at[hit]
            start.append(own + word[own])
            end.append(own + word[own] + length)
            piece.append(v.numbers[k[hit]])
        start, end, piece = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
        node_word = np.repeat(np.arange(len(words)), size + 1)
        depth = end - self.first[node_word[end]]
        order = np.lexsort((end, depth))
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self.steps = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to reach every node from its word's start."""
        alpha = np.zeros(self.nodes)
        self.way = np.empty(len(self.start))
        for a, b in zip(self.steps[:-1].tolist(), self.steps[1:].tolist()):
            x = alpha[self.start[a:b]] + logp[self.piece[a:b]]
            ends = self.end[a:b]
            group = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
            times = np.diff(np.append(group, b - a))
            top = np.maximum.reduceat(x, group)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, times)), group))
            alpha[ends[group]] = total
            self.way[a:b] = np.exp(x - np.repeat(total, times))
        return alpha

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, each word weighted by its count: the flow back along the forward ways."""
        self.forward(logp)
        flow = np.zeros(self.nodes)
        flow[self.last] = counts
        out = np.zeros(len(logp))
        for a, b in zip(self.steps[:-1][::-1].tolist(), self.steps[1:][::-1].tolist()):
            w = flow[self.end[a:b]] * self.way[a:b]
            flow[self.start[a:b]] += w  # starts of one step are distinct nodes
            out += np.bincount(self.piece[a:b], w, len(logp))
        return out


def _blocks(words: list[bytes]) -> Iterator[np.ndarray]:
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(order), WORDS):
        yield order[i : i + WORDS]


def log_probabilities(words: list[bytes], v: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Natural log of every word's probability, summed over all its segmentations."""
    out = np.zeros(len(words))
    for block in _blocks(words):
        own = Lattices([words[i] for i in block], v)
        out[block] = own.forward(logp)[own.last]
    return out


def _expected(v: Vocabulary, logp: np.ndarray):
    def part(frame: pd.DataFrame) -> np.ndarray:
        words, counts = [bytes(w) for w in frame["word"]], frame["c"].to_numpy(float)
        total = np.zeros(len(logp))
        for block in _blocks(words):
            total += Lattices([words[i] for i in block], v).expected(logp, counts[block])
        return total

    return part


def _pack(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """A document's word numbers, rising, and how often each stands."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").tobytes() + times.astype("<i4").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, times = np.frombuffer(zlib.decompress(packed), "<i4").reshape(2, -1)
    return np.cumsum(gaps), times


class _Chunk:
    """Documents whose distinct words travel together; texts are hashed piece by piece as they come."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids: list = []
        self.held_out: list[bool] = []
        self.texts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        self.hashes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch) -> None:
        joined, starts, ends, hashes, offsets = word_spans(texts(batch))
        self.ids += batch.column("doc_id").to_pylist()
        self.held_out += batch.column("held_out").to_pylist()
        self.texts.append((joined, starts, ends))
        self.hashes.append(hashes)
        self.words.append(np.diff(offsets))
        self.size += len(joined)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """(the distinct words, every word's number among them): told apart by hashes and compared with their bytes."""
        distinct, first, inverse = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        bounds = np.cumsum([0, *(len(h) for h in self.hashes)])
        words = [b""] * len(distinct)
        for (joined, starts, ends), a, b in zip(self.texts, bounds, bounds[1:]):
            own = np.flatnonzero((first >= a) & (first < b))
            at = first[own] - a
            for i, x, y in zip(own.tolist(), starts[at].tolist(), ends[at].tolist()):
                words[i] = joined[x:y]
        flat, stop = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64)
        begin = np.concatenate(([0], stop))[:-1]
        for (joined, starts, ends), a, b in zip(self.texts, bounds, bounds[1:]):
            own = inverse[a:b]
            if not same_spans(np.frombuffer(joined, np.uint8), starts, ends, flat, begin[own], stop[own]):
                break
        else:
            return words, inverse
        number: dict[bytes, int] = {}  # words that share a hash: number them by their bytes
        every = (joined[x:y] for joined, starts, ends in self.texts for x, y in zip(starts.tolist(), ends.tolist()))
        inverse = np.array([number.setdefault(w, len(number)) for w in every], np.int64)
        return list(number), inverse

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        words, inverse = self.distinct()
        order = sorted(range(len(words)), key=words.__getitem__)  # in order, words compress better
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        place = number[inverse]
        doc = np.repeat(np.arange(len(self.ids)), np.concatenate(self.words))
        trained = np.bincount(place[~np.array(self.held_out, bool)[doc]], minlength=len(words))
        pairs, times = np.unique(doc << 32 | place, return_counts=True)
        at = np.searchsorted(pairs, np.arange(len(self.ids) + 1, dtype=np.int64) << 32).tolist()
        low = pairs & 0xFFFFFFFF
        bags = [_pack(low[a:b], times[a:b]) for a, b in zip(at, at[1:])]
        w, d = len(words), len(self.ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number << NUMBER_BITS | i for i in range(w)] + [self.number << NUMBER_BITS] * d, pa.int64()),
             pa.array([*(words[i] for i in order), *[None] * d], pa.binary()), pa.array([*trained.tolist(), *[None] * d], pa.int64()),
             pa.array([*[None] * w, *self.ids], kind), pa.array([*[None] * w, *self.held_out], pa.bool_()), pa.array([*[None] * w, *bags], pa.binary())],
            names=["place", "word", "n", "doc_id", "held_out", "bag"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every chunk one row a distinct word and one row a document, with its word numbers and their counts."""
    chunk = _Chunk(TaskContext.get().partitionId() << CHUNK_BITS)
    kind = None
    for batch in pieces(batches, limit=1 << 20):
        kind = batch.schema.field("doc_id").type
        chunk.add(batch)
        if chunk.size >= CHUNK:
            yield chunk.rows(kind)
            chunk = _Chunk(chunk.number + 1)
    if chunk.ids:
        yield chunk.rows(kind)


def score(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose crc32(doc_id) mod 7 is not 2 (a null id counts as the empty text). Null and empty texts consist of
    the end alone. Repeated rows count and are scored as often as they stand. With no training row the piece
    probabilities are the prior's. Words are told apart by their bytes.
    """
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    v = vocabulary(path)
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
        "doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    parts = cut(rows.mapInArrow(_split, f"place bigint, word binary, n bigint, doc_id {kind}, held_out boolean, bag binary"), "zstd")
    chunk = F.shiftright("place", NUMBER_BITS).alias("chunk")
    terms, bags = parts.where("word is not null").select("place", "word", "n"), parts.where("bag is not null").select(chunk, "doc_id", "held_out", "bag")
    table = cut(terms.groupBy("word").agg(F.sum("n").alias("c")), "zstd")
    ends = bags.where("not held_out").count()
    sums = table.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    p = v.prior
    for _ in range(rounds if ends else 0):
        found = array_sum(table.where("c > 0"), ["word", "c"], len(p), _expected(v, np.log(p)))
        found[-1] = ends
        p = (found + PRIOR * v.prior) / (found.sum() + PRIOR)
    logp = np.log(p)
    shared = spark.sparkContext.broadcast((v, logp))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log = shared.value
        for batch in batches:
            if batch.num_rows:
                found = log_probabilities(batch.column("word").to_pylist(), own, log)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["word", "c", "log"])

    scored = table.mapInArrow(words, "word binary, c bigint, log double")
    # what comes back to a chunk is packed in every task into one row of plain arrays
    known = terms.select("place", "word").join(scored, "word").groupBy(chunk).agg(
        F.collect_list(F.col("place").bitwiseAND((1 << NUMBER_BITS) - 1).cast("int")).alias("number"), F.collect_list("c").alias("c"), F.collect_list("log").alias("log"))
    end, more = float(logp[-1]), tokens + distinct + 1

    def bag(term: pa.Table, own: pa.Table) -> pa.Table:
        numbers, counts, logs = (np.concatenate([np.asarray(x.values) for x in term.column(k)] or [np.zeros(0)]) for k in ("number", "c", "log"))
        c, log = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
        at = numbers.astype(np.int64)
        c[at], log[at] = counts, logs
        base = np.log10((c + 1) / more)
        out = []
        for packed in own.column("bag").to_pylist():
            i, t = _unpack(packed)
            out.append((int(t.sum()) + 1, int(t[c[i] > 0].sum()) + (ends > 0), float((t * base[i]).sum() + np.log10((ends + 1) / more)),
                        float(((t * log[i]).sum() + end) / np.log(10))))
        tokens_, known_, base_, score_ = zip(*out)
        return pa.table([own.column("doc_id"), own.column("held_out"), pa.array(tokens_, pa.int64()), pa.array(known_, pa.int64()), pa.array(base_), pa.array(score_)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return known.groupBy("chunk").cogroup(bags.withColumnRenamed("chunk", "home").groupBy("home")).applyInArrow(
        bag, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
