"""Alignment of two tokenizers over the same bytes by interval coalescing.

The tokens of both tokenizers are intervals of the bytes of a blank and the text. All intervals of a batch are sorted by their
start and the ends are accumulated to a running maximum; a group ends where a start reaches that maximum, which is where
both tokenizers end a token. Inside the groups every token of A meets the tokens of B that its bytes overlap.

Corpus counts of linked id pairs need no row per link: a task numbers the distinct pairs of a chunk of documents, documents keep the
numbers of their pairs, and the chunk's list of pairs travels once to the corpus counts and back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.bytepair import Cache, encode_batch, merging
from winnow.llm.common import cut, pieces, prepare, spread
from winnow.llm.packing import ranks_of

PIECE_BYTES = 1 << 20  # text aligned at a time
CHUNK_BYTES = 24 << 20  # text whose distinct pairs are numbered together


@lru_cache(1)
def _first(data: str) -> tuple[Cache, np.ndarray, np.ndarray]:
    """(encoder of A, bytes of all its tokens, offsets by id)."""
    ranks = ranks_of(data)
    if ranks is None:
        raise ValueError("the first tokenizer must be byte-level BPE whose ids are merge ranks")
    return merging(ranks), *_table({i: w for w, i in ranks.items()})


@lru_cache(1)
def _second(data: bytes) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray, np.ndarray]:
    """(encoder of B, bytes of all its pieces with a blank for U+2581, offsets by id)."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    words = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        words[i] = bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return model, *_table(words)


def _table(words: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    every = [words.get(i, b"") for i in range(max(words) + 1)]
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *(len(w) for w in every)])


def _gather(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries of ids one after another, where each of them ends)."""
    size = (offsets[1:] - offsets[:-1])[ids]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[ids] - (ends - size), size)], ends


@lru_cache(4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n in decimal, each with one more byte for what follows it."""
    return _table({i: b"%d," % i for i in range(n)})


def encode(texts: list[str | None], a: str, b: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of both tokenizers for every text; none where the text is null or empty or either one's bytes differ from a blank and the text."""
    cache, flat_a, offsets_a = _first(a)
    model, flat_b, offsets_b = _second(b)
    full = [i for i, t in enumerate(texts) if t]
    out_a, out_b = ([np.zeros(0, np.int64)] * len(texts) for _ in range(2))
    ids_a = encode_batch([" " + texts[i] for i in full], cache)
    ids_b = model.encode([texts[i] for i in full], num_threads=1)
    for i, x, y in zip(full, ids_a, ids_b):
        x, y = x.astype(np.int64), np.array(y, np.int64)
        want = b" " + texts[i].encode("utf-8", "surrogatepass")
        if all(_gather(flat, offsets, ids)[0].tobytes() == want for flat, offsets, ids in ((flat_a, offsets_a, x), (flat_b, offsets_b, y))):
            out_a[i], out_b[i] = x, y
    return out_a, out_b


def coalesce(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B token; both cover the same bytes, so ends say all."""
    n = len(ends_a)
    ends = np.concatenate([ends_a, ends_b])
    starts = np.concatenate([ends_a, ends_b])
    starts[1:n], starts[n + 1 :] = ends_a[:-1], ends_b[:-1]
    starts[:1] = starts[n : n + 1] = 0
    order = np.lexsort((np.arange(len(ends)) >= n, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(ends), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:n], group[n:]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) whose byte ranges overlap."""
    begin = np.concatenate(([0], ends_a[:-1])) if len(ends_a) else ends_a
    low = np.searchsorted(ends_b, begin, "right")
    times = np.searchsorted(ends_b, ends_a, "left") + 1 - low
    first = np.cumsum(times) - times
    left = np.repeat(np.arange(len(ends_a)), times)
    return left, np.arange(len(left)) + np.repeat(low - first, times)


def spell(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for runs of tokens[i] tokens of both sides together: ids in order, groups apart."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    ids, follow = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    before_b = np.searchsorted(group_b, np.arange(n))  # B tokens of earlier groups
    upto_a = np.searchsorted(group_a, np.arange(n), "right")
    for own, group, place, last in ((ids_a, group_a, np.arange(len(ids_a)) + before_b[group_a], b"|"), (ids_b, group_b, np.arange(len(ids_b)) + upto_a[group_b], b";")):
        ids[place] = own
        follow[place] = np.where(np.append(group[1:] != group[:-1], True), last[0], b","[0])[: len(own)]
    flat, offsets = _digits(int(ids.max(initial=0)) + 1 | 0xFFFF)
    text, ends = _gather(flat, offsets, ids)
    text[ends - 1] = follow
    stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(tokens)))].tolist()
    whole = text.tobytes()
    return [whole[a : b - 1] if b > a else b"" for a, b in zip(stops, stops[1:])]


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each, after one byte that tells how many."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top >> 8 * w == 0)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Numbering:
    """Places of distinct id pairs in the order of their arrival, and how many documents hold each."""

    def __init__(self):
        self.sorted, self.place, self.documents, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The places of distinct, sorted pairs."""
        at = np.searchsorted(self.sorted, pairs)
        known = at < len(self.sorted)
        known[known] = self.sorted[at[known]] == pairs[known]
        new = pairs[~known]
        if len(new):
            self.place = np.insert(self.place, at[~known], np.arange(len(self.sorted), len(self.sorted) + len(new)))
            self.sorted = np.insert(self.sorted, at[~known], new)
            self.documents = np.append(self.documents, np.zeros(len(new), np.int64))
            at = np.searchsorted(self.sorted, pairs)
        return self.place[at]

    def listed(self) -> np.ndarray:
        """The pairs by place."""
        out = np.empty(len(self.sorted), np.int64)
        out[self.place] = self.sorted
        return out


_FIELDS = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, chunk bigint, places binary, times binary, "
           "pairs binary, documents binary")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links and groups (`a1,a2|b1;a3|b2,b3`); and what with_counts needs.

    A is a byte-level BPE file whose ids are merge ranks, B a sentencepiece model; A encodes a blank and the text, B the text,
    and strings of special tokens are plain text. A text that is null or empty, or that either tokenizer does not give
    back byte by byte (for one, a text with U+2581), has no tokens: zeros and empty groups. Null ids and repeated rows are rows like
    any other; whole texts are aligned, a very long one as a batch of its own. Only the two named columns are read;
    an empty table gives no rows. Rows with `pairs` are no documents but the list of pairs of a chunk. Files are read by the driver and
    broadcast: their size is that of a vocabulary.
    """
    spark = prepare(docs.sparkSession)
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    kind = dict(docs.dtypes)[doc_id]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        sizes = [np.diff(t[2]) for t in (_first(a), _second(b))]
        numbers, chunk, id_type = Numbering(), _chunk(), None

        def listed() -> pa.RecordBatch:
            own = [pa.nulls(1, id_type), *(pa.nulls(1, t) for t in _TYPES[:5]), pa.array([chunk], pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(2)),
                   pa.array([numbers.listed().tobytes()], pa.binary()), pa.array([pack(numbers.documents)], pa.binary())]
            return pa.RecordBatch.from_arrays(own, names=_NAMES)

        for batch in pieces(batches, limit=PIECE_BYTES):
            id_type = batch.schema.field("doc_id").type
            rows = batch.column("text").to_pylist()
            ids_a, ids_b = encode(rows, a, b)
            n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
            flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
            ends_a, ends_b = np.cumsum(sizes[0][flat_a]), np.cumsum(sizes[1][flat_b])
            group_a, group_b = coalesce(ends_a, ends_b)
            left, right = overlaps(ends_a, ends_b)
            row_of = np.repeat(np.arange(len(rows)), n_a)
            groups = np.bincount(row_of[np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]], minlength=len(rows))
            n_links = np.bincount(row_of[left], minlength=len(rows))

            # per document the places of its distinct pairs, ascending, and how often it has each
            pairs, place = np.unique(flat_a[left] << 32 | flat_b[right], return_inverse=True)
            own = numbers.of(pairs)[place]
            top = len(numbers.sorted) + 1
            held, times = np.unique(row_of[left] * top + own, return_counts=True)
            row, own = np.divmod(held, top)
            np.add.at(numbers.documents, own, 1)
            stops = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
            spans = list(zip(stops, stops[1:]))
            columns = [n_a, n_b, groups, n_links, spell(flat_a, flat_b, group_a, group_b, n_a + n_b), np.full(len(rows), chunk),
                       [pack(np.diff(own[s:e], prepend=0)) for s, e in spans], [pack(times[s:e]) for s, e in spans]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES)), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())],
                names=_NAMES)
            numbers.bytes += sum(len(t) for t in rows if t)
            if numbers.bytes >= CHUNK_BYTES:
                if len(numbers.sorted):
                    yield listed()
                numbers, chunk = Numbering(), _chunk()
        if len(numbers.sorted):
            yield listed()

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(scan, f"doc_id {kind}, {_FIELDS}")


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "chunk", "places", "times", "pairs", "documents"]


def _chunk() -> int:
    return int.from_bytes(os.urandom(8), "little") >> 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per pair of a chunk."""
    for batch in batches:
        for chunk, pairs, documents in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "documents"))):
            pairs = np.frombuffer(pairs, np.int64)
            for s in range(0, len(pairs), 65_536):
                own = pairs[s : s + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), chunk)), pa.array(np.arange(s, s + len(own), dtype=np.int32)), pa.array(own),
                     pa.array(unpack(documents)[s : s + 65_536])], names=["chunk", "place", "pair", "documents"])


def _counted(names: list[str], types: list[pa.DataType]):
    def work(rows: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows
        place = counts.column("place").to_numpy()
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        n_best, total = [], []
        for places, times in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist()):
            own, often = np.cumsum(unpack(places)), unpack(times)
            n_best.append(int(best[own] @ often))
            total.append(int(count[own] @ often))
        return pa.table([*(rows.column(n).cast(t) for n, t in zip(names, types)), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                        names=[*names, "n_best", "count_sum"])

    return work


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, documents, best): in how many documents an id pair is linked, and whether no pair of the same a is linked in more."""
    entries = aligned.where("pairs is not null").select("chunk", "pairs", "documents").mapInArrow(
        _entries, "chunk bigint, place int, pair bigint, documents bigint")
    counts = entries.groupBy("pair").agg(F.sum("documents").alias("documents"))
    parts = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "documents")
    # pairs of one a: at most the second vocabulary
    return parts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def with_counts(aligned: DataFrame) -> DataFrame:
    """The documents of aligned (with any further columns) and n_best (links whose pair is a best one of its a), count_sum (documents summed over links).

    `aligned` is written once to the checkpoint folder; a chunk's documents meet the counts of the chunk's own pairs.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    aligned = cut(aligned, "zstd")
    counts = pair_counts(aligned).select(
        (F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), F.col("documents").alias("count"), F.col("best").cast("bigint").alias("best"))
    entries = aligned.where("pairs is not null").select("chunk", "pairs", "documents").mapInArrow(
        _entries, "chunk bigint, place int, pair bigint, documents bigint")
    per_chunk = entries.select("chunk", "place", "pair").join(counts, "pair").select("chunk", "place", "count", "best")
    rows = aligned.where("pairs is null").drop("pairs", "documents")
    out = [f for f in rows.schema.fields if f.name not in ("chunk", "places", "times")]
    work = _counted([f.name for f in out], [to_arrow_type(f.dataType) for f in out])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_best bigint, count_sum bigint"
    return rows.groupBy("chunk").cogroup(per_chunk.groupBy("chunk")).applyInArrow(lambda left, right: work(left, right), schema)
