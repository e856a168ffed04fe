"""Byte-level BPE: vectorised splitting, cached merging, table decoding.

The characters of a batch become symbols: letter, number, other, apostrophe that opens a contraction, and white space by what
follows it. Splitting is an automaton over these symbols with eight states, and a character's effect is a function from state to
state. Composition of such functions is associative, so blocks of characters are composed side by side, the blocks'
functions are scanned, and then every block is replayed from its known first state to read off where tokens
begin. No regular expression runs. The slices go to pair merging through a cache, and every token keeps its
byte length, so that decoding is one gather from the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import pieces, prepare, spread, with_columns, with_fields
from winnow.llm.wordhash import same_spans, span_hashes

LETTER, NUMBER, OTHER, SHORT, LONG, LAST_BLANK, LAST_SPACE, MID_SPACE = range(8)
# states: no open token, in a run of each class, after a blank that joins what follows, in white space, 1 or 2 characters of a contraction to go
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, BLANK, IN_SPACE, ONE, TWO = range(8)
WIDTH = 64
CACHE = 120_000  # slices of a generation of a worker's cache
SHORT_PIECE = 32  # bytes; longer pieces are merged one by one with a heap
NO_RANK = 1 << 30
MANY = 16_384  # pieces merged side by side


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol * 8 + state; a symbol plus 8 is the first character of a text."""
    go, begin = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    runs = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SHORT: IN_OTHER, LONG: IN_OTHER}
    fresh = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SHORT: ONE, LONG: TWO, LAST_BLANK: BLANK, LAST_SPACE: NONE, MID_SPACE: IN_SPACE}
    for symbol, state in fresh.items():
        go[symbol] = go[symbol + 8] = state
    for symbol, run in runs.items():
        for state in (run, BLANK):
            go[symbol, state], begin[symbol, state] = run, False
    go[MID_SPACE, IN_SPACE], begin[MID_SPACE, IN_SPACE] = IN_SPACE, False
    go[LETTER, ONE], begin[LETTER, ONE] = NONE, False
    go[LETTER, TWO], begin[LETTER, TWO] = ONE, False
    return go.ravel(), begin.ravel()


_GO, _BEGIN = _automaton()


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that sequences of symbols make: (value by function and state, function by function and next symbol, products)."""
    step = _GO.reshape(16, 8)
    known = {tuple(range(8)): 0}
    queue, after = [tuple(range(8))], []
    for f in queue:  # grows while it is read
        row = []
        for symbol in range(16):
            g = tuple(step[symbol, list(f)].tolist())
            if g not in known:
                known[g] = len(queue)
                queue.append(g)
            row.append(known[g])
        after.append(row)
    value = np.array(queue, np.uint8)
    product = np.array([[known[tuple(g[list(f)].tolist())] for g in value] for f in queue], np.uint16)
    return value, np.array(after, np.uint16), product


_VALUE, _AFTER, _PRODUCT = _closure()
#: White space outside the categories of letters and numbers.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[_BLANKS] = MID_SPACE
    return table


def _symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every character; first holds where texts begin."""
    s = _classes()[codes]
    start = np.zeros(len(codes) + 1, bool)
    start[first] = start[-1] = True
    space = s == MID_SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~start[1:-1])
    s[last] = np.where(codes[last] == 32, LAST_BLANK, LAST_SPACE)
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        def after(k: int) -> np.ndarray:
            at = np.minimum(quote + k, len(codes) - 1)
            own = quote + k < len(codes)
            for step in range(1, k + 1):
                own &= ~start[np.minimum(quote + step, len(codes))]
            return np.where(own, codes[at], 0)

        a, b = after(1), after(2)
        s[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), bool)
        for two in ("re", "ve", "ll"):
            pair |= (a == ord(two[0])) & (b == ord(two[1]))
        s[quote[pair]] = LONG
    s[first] += 8
    return s


def _scan(functions: np.ndarray) -> np.ndarray:
    """The product of all functions before every function: an exclusive scan, block by block."""
    n = len(functions)
    out = np.zeros(n, np.uint16)
    if n <= WIDTH:
        for i in range(1, n):
            out[i] = _PRODUCT[out[i - 1], functions[i - 1]]
        return out
    rows = -(-n // WIDTH)
    block = np.zeros(rows * WIDTH, np.uint16)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, WIDTH).T)
    total = np.zeros(rows, np.uint16)
    for t in range(WIDTH):
        total = _PRODUCT[total, block[t]]
    before = _scan(total)
    out = np.empty((WIDTH, rows), np.uint16)
    for t in range(WIDTH):
        out[t] = before
        before = _PRODUCT[before, block[t]]
    return out.T.ravel()[:n]


def token_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts joined, its code points, where tokens begin and the end, every text's first token and the number of tokens)."""
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return joined, codes, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    s = _symbols(codes, np.unique(begin[:-1][lengths > 0]))
    rows = -(-n // WIDTH)
    block = np.full(rows * WIDTH, OTHER, np.uint8)
    block[:n] = s
    block = np.ascontiguousarray(block.reshape(rows, WIDTH).T)
    function = np.zeros(rows, np.uint16)
    for t in range(WIDTH):
        function = _AFTER[function, block[t]]
    state = _VALUE[_scan(function), NONE]
    starts = np.empty((WIDTH, rows), bool)
    for t in range(WIDTH):
        at = (block[t] << 3) | state
        starts[t], state = _BEGIN[at], _GO[at]
    cut = np.flatnonzero(starts.T.ravel()[:n])
    return joined, codes, np.append(cut, n), np.searchsorted(cut, begin)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue
        live[j], end[i] = False, stop
        if stop < n:
            left[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        k = left[i]
        if k >= 0:
            rank = ranks.get(piece[k:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Pairs:
    """Ranks of token pairs in an open-addressed table, looked up many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.full(256, -1, np.int32)
        for i in range(256):
            self.single[i] = ranks.get(bytes([i]), -1)
        found = [(ranks[w[:k]], ranks[w[k:]], r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.mask = (1 << max(4, (4 * len(found)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NO_RANK, np.int32)
        todo, key = np.arange(len(found)), left << 32 | right
        slot = self._slot(key)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]  # of several the last stays
            won = free[self.keys[slot[free]] == key[free]]
            self.ranks[slot[won]] = rank[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).view(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; NO_RANK where the pair makes no token."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        out = np.full(len(key), NO_RANK, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            here = self.keys[slot[todo]]
            hit = here == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out


def merge_many(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[bytes]:
    """merge() of many short pieces side by side, as bytes: every round merges each piece's leftmost pair of lowest rank.

    A piece is a row of tokens linked to their neighbours, so a round touches only the merged token and the pairs beside it.
    The last column belongs to no token and ends the links at both sides.
    """
    out = [b""] * len(words)

    def finish(which: np.ndarray, ids: np.ndarray) -> None:
        full = ids >= 0
        flat = ids[full].astype("<u4").tobytes()
        ends = np.cumsum(full.sum(1)) * 4
        for i, a, b in zip(which.tolist(), [0, *ends.tolist()], ends.tolist()):
            out[i] = flat[a:b]

    whole = np.array([ranks.get(w, -1) for w in words], np.int32)
    known = np.flatnonzero(whole >= 0)
    finish(known, whole[known, None])
    which = np.flatnonzero(whole < 0)
    if not len(which):
        return out
    size = np.array([len(words[i]) for i in which])
    width = int(size.max()) + 1
    columns = np.arange(width, dtype=np.int32)
    inside = columns < size[:, None]
    ids = np.full(inside.shape, -1, np.int32)
    ids[inside] = pairs.single[np.frombuffer(b"".join([words[i] for i in which]), np.uint8)]
    after = np.where(columns + 1 < size[:, None], columns + 1, width - 1).astype(np.int32)
    before = np.where(columns > 0, columns - 1, width - 1).astype(np.int32) + np.zeros((len(which), 1), np.int32)
    rank = np.full(ids.shape, NO_RANK, np.int32)
    at = np.flatnonzero(inside[:, :-1] & inside[:, 1:])
    at += at // (width - 1)  # from rows one shorter
    rank.ravel()[at] = pairs.rank(ids.ravel()[at], ids.ravel()[at + 1])
    while True:
        column = rank.argmin(1)
        base = np.arange(len(ids)) * width
        low = rank.ravel()[base + column]
        on = low != NO_RANK
        if not on.any():
            finish(which, ids)
            return out
        if on.mean() < 0.7:
            finish(which[~on], ids[~on])
            which, ids, rank, after, before, column, low = (x[on] for x in (which, ids, rank, after, before, column, low))
            base = np.arange(len(ids)) * width
        else:
            base, column, low = base[on], column[on], low[on]
        flat, ranked, right, left = ids.ravel(), rank.ravel(), after.ravel(), before.ravel()
        here = base + column
        gone = base + right[here]
        next_, last = base + right[gone], base + left[here]
        flat[here], flat[gone] = low, -1
        right[here], left[next_] = right[gone], column
        ranked[gone] = NO_RANK
        for a, b in ((here, next_), (last, here)):
            x, y = flat[a], flat[b]
            both = (x >= 0) & (y >= 0)
            ranked[a] = NO_RANK
            ranked[a[both]] = pairs.rank(x[both], y[both])


class Cache:
    """Ids of slices as little-endian bytes, in two generations: when the young one is full it replaces the old one.

    Memory stays bounded, and slices in use stay known.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, slices: list[str]) -> list[bytes]:
        """The ids of every slice; what is not known yet is encoded all at once."""
        young, old = self.young, self.old
        if len(young) > CACHE:
            self.young, self.old = {}, young
            young, old = self.young, self.old
        unseen = [s for s in slices if s not in young]
        new = []
        for s in unseen:
            ids = old.get(s)
            if ids is None:
                new.append(s)
            else:
                young[s] = ids
        new.sort(key=len)
        for start in range(0, len(new), MANY):
            part = new[start : start + MANY]
            young.update(zip(part, self.encode(part)))
        return [young[s] for s in slices]


def _distinct(codes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a token of every distinct slice, every token's place among these).

    Slices are told apart by a 64-bit hash, read off one running sum, and compared with the slice that stands for them; where
    one differs, slices are told apart by themselves.
    """
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    starts, ends = cut[:-1], cut[1:]
    _, first, place = np.unique(span_hashes(value, starts, ends, table=None), return_index=True, return_inverse=True)
    if not same_spans(codes, starts, ends, codes, starts[first][place], ends[first][place]):
        number: dict[bytes, int] = {}
        place = np.array([number.setdefault(codes[a:b].tobytes(), len(number)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        first = np.unique(place, return_index=True)[1]
    return first, place


def encode_batch(texts: list[str], cache: Cache) -> list[np.ndarray]:
    """The ids of every text; only distinct slices become Python objects."""
    joined, codes, cut, at = token_starts(texts)
    if len(cut) < 2:
        return [np.zeros(0, "<u4")] * len(texts)
    first, place = _distinct(codes, cut)
    ids = cache.of([joined[a:b] for a, b in zip(cut[first].tolist(), cut[first + 1].tolist())])
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.array([len(i) for i in ids], np.int64) // 4
    begin = np.cumsum(size) - size
    times = size[place]
    ends = np.cumsum(times)
    out = flat[np.arange(ends[-1]) + np.repeat(begin[place] - (ends - times), times)]
    bounds = np.concatenate(([0], ends))[at].tolist()
    return [out[a:b] for a, b in zip(bounds, bounds[1:])]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank, one a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(4)
def _ranks(data: bytes) -> dict[bytes, int]:
    return read_ranks(data)


def merging(ranks: dict[bytes, int]) -> Cache:
    """A cache over pair merging by ranks."""
    pairs = Pairs(ranks)

    def encode(slices: list[str]) -> list[bytes]:
        words = [w.encode("utf-8", "surrogatepass") for w in slices]
        short = [i for i, w in enumerate(words) if len(w) <= SHORT_PIECE]
        out = [b""] * len(words)
        for i, ids in zip(short, merge_many([words[i] for i in short], ranks, pairs)):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SHORT_PIECE:
                out[i] = np.array(merge(w, ranks), "<u4").tobytes()
        return out

    return Cache(encode)


@lru_cache(4)
def encoder(data: bytes) -> Cache:
    return merging(_ranks(data))


@lru_cache(4)
def vocabulary(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all tokens in the order of their ids, offsets by id)."""
    ranks = _ranks(data)
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, i in ranks.items():
        words[i] = word
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)


def decode_ids(ids: bytes, data: bytes) -> bytes:
    """The bytes of a sequence of ids, by one gather."""
    flat, offsets = vocabulary(data)
    i = np.frombuffer(ids, "<u4")
    if not len(i):
        return b""
    first, lengths = offsets[i], (offsets[1:] - offsets[:-1])[i]
    ends = np.cumsum(lengths, dtype=np.int32)
    return flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(first - (ends - lengths), lengths)].tobytes()


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit numbers) of the whole text; null and empty texts have none.

    Null ids and repeated rows are rows like any other. A very long text is a batch of its own. An empty table gives no rows. Only the
    two named columns are read.

    The rank file is read once by the driver and broadcast: its size is that of a vocabulary.
    """
    spark = prepare(docs.sparkSession)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(shared.value)
        for batch in pieces(batches):
            ids = encode_batch([t or "" for t in batch.column("text").to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)[doc_id]
    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(scan, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column `bytes`, which it must not have yet: what its ids stand for. Null ids give null, no ids the empty string;
    rows and columns stay as they are, in an empty table too."""
    spark = prepare(encoded.sparkSession)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 8 << 20):
            out = [None if i is None else decode_ids(i, shared.value) for i in batch.column("ids").to_pylist()]
            yield with_columns(batch, {"bytes": pa.array(out, pa.binary())})

    return encoded.mapInArrow(scan, with_fields(encoded, {"bytes": "binary"}))
