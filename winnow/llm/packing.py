"""Packing along a space-filling curve.

A document's hashed token counts are scaled to length one and projected to three numbers; their place on a Hilbert curve
is the sort key, so that documents near each other on the curve hold similar tokens. The ranges of the sorted
table are numbered through with one number a range at the driver, which gives every document its place in one
long stream; the stream is cut every 2048 tokens. Its last, incomplete part becomes sequences of powers of two,
so nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from winnow.llm.bytepair import Cache, encode_batch, merging
from winnow.llm.common import BATCH_BYTES, cut, pieces, prepare, spread

LENGTH = 2048
END = 1  # id after every document
HASHED, AXES, BITS = 256, 3, 10
RANGE = 100_000  # documents a range of the sorted table


def ranks_of(data: str) -> dict[bytes, int] | None:
    """The ids of a byte-level BPE tokenizer file by their bytes; None where ids do not rise with the order of the merges, so that they are no ranks.

    Such files spell a byte as a character: printable bytes as themselves, the others in turn from 256 on.
    """
    model = json.loads(data)["model"]
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:])) or (ids and ids[0] < 0) or not all(c in byte for w in model["vocab"] for c in w):
        return None
    return {bytes(byte[c] for c in w): i for w, i in model["vocab"].items()}


@lru_cache(2)
def _tokenizer(data: str) -> Tokenizer:
    return Tokenizer.from_str(data)


@lru_cache(1)
def codec() -> pa.Codec:
    """Ids lie on disk twice, in a table and in a shuffle, whose own codecs leave a quarter more of them."""
    return pa.Codec("zstd", 3)


@lru_cache(2)
def _slices(data: str) -> tuple[Cache, list[str]]:
    """A cache of slices, and the tokenizer's added tokens. Where the ids are ranks, slices are merged in batches; otherwise the tokenizer encodes them."""
    ranks = ranks_of(data)

    def encode(slices: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(data).encode_batch(slices, add_special_tokens=False)]

    return merging(ranks) if ranks else Cache(encode), [t["content"] for t in json.loads(data)["added_tokens"]]


def token_ids(texts: list[str], data: str) -> list[np.ndarray]:
    """What tokenizer.encode(text, add_special_tokens=False) gives for every text, with the end id.

    Splitting and batched merging are shared with the byte-pair operator; a text that spells out an added token goes to the
    tokenizer whole, which alone knows how to cut it and is loaded only then.
    """
    cache, added = _slices(data)
    plain = [t if not any(a in t for a in added) else "" for t in texts]
    out = []
    for text, own, ids in zip(texts, plain, encode_batch(plain, cache)):
        if text and not own:
            ids = np.array(_tokenizer(data).encode(text, add_special_tokens=False).ids, np.uint32)
        out.append(np.append(ids, np.uint32(END)))
    return out


_rng = np.random.default_rng(31)
_AXIS = _rng.normal(size=(HASHED, AXES))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one a row, each number below 2^bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of every level
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> bit & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of every document's hashed token counts."""
    counts = np.zeros((len(ids), HASHED))
    for i, own in enumerate(ids):
        h = own * np.uint32(0x9E3779B1)
        sign = np.where(h >> np.uint32(31), 1.0, -1.0)
        counts[i] = np.bincount(h >> np.uint32(15) & np.uint32(HASHED - 1), sign, HASHED)
    size = np.maximum(np.sqrt((counts**2).sum(1)), 1.0)
    place = (counts @ _AXIS) / size[:, None]
    return hilbert(np.clip((place + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def last_lengths(tokens: int) -> list[int]:
    """Lengths of the sequences after the full ones: the powers of two in the rest."""
    return [1 << b for b in range(10, -1, -1) if tokens % LENGTH >> b & 1]


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every id lies in one piece and a sequence's pieces fill it without gaps. Null and empty texts are the end id alone;
    repeated rows and null ids are documents of their own. An empty table gives no rows. The tokenizer file is read by
    the driver and broadcast: its size is that of a vocabulary.
    """
    spark = prepare(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = token_ids([t or "" for t in batch.column("text").to_pylist()], shared.value)
            kind = "<u2"  # ids below 2^16 take two bytes on disk
            if max(int(i.max()) for i in ids) >> 16:
                kind = "<u4"
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(curve_keys(ids)), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([np.dtype(kind).itemsize] * len(ids), pa.int32()), pa.array([codec().compress(i.astype(kind).tobytes(), asbytes=True) for i in ids], pa.binary())],
                names=["doc_id", "row", "key", "n", "wide", "ids"])

    kind = dict(docs.dtypes)[doc_id]
    raw = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(raw.mapInArrow(scan, f"doc_id {kind}, row bigint, key bigint, n bigint, wide int, ids binary"))

    # places in the stream: a running sum inside every range, after the sums of the ranges before
    ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    sorted_ = cut(rows.select("row", "key", "n").repartitionByRange(ranges, "key", "row").withColumn("range", F.spark_partition_id()))
    sums = sorted_.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    total = sum(s["n"] for s in sums)
    before = np.cumsum([0, *(s["n"] for s in sums)]).tolist()
    first = spark.createDataFrame([(s["range"], b) for s, b in zip(sums, before)], "range int, before bigint")
    within = F.sum("n").over(Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = sorted_.withColumn("first", within - F.col("n")).join(F.broadcast(first), "range").select("row", (F.col("first") + F.col("before")).alias("first"))

    full = total // LENGTH
    ends = np.cumsum([full * LENGTH, *last_lengths(total)]).tolist()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", BATCH_BYTES // 2):
            out: list[tuple] = []
            for name, at, n, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "wide", "ids"))):
                ids = codec().decompress(ids, decompressed_size=n * wide)
                data = np.frombuffer(ids, f"<u{wide}").astype("<u4").tobytes()
                a = 0
                while a < n:
                    place = at + a
                    if place < ends[0]:
                        sequence, offset = divmod(place, LENGTH)
                        b = min(n, a + LENGTH - offset)
                    else:
                        k = next(k for k in range(1, len(ends)) if place < ends[k])
                        sequence, offset = full + k - 1, place - ends[k - 1]
                        b = min(n, a + ends[k] - place)
                    out.append((name, a, b - a, data[4 * a : 4 * b], n, sequence, offset))
                    a = b
            columns = list(zip(*out))
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=PIECE)

    return rows.join(places, "row").select("doc_id", "first", "n", "wide", "ids").mapInArrow(
        deal, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


PIECE = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
