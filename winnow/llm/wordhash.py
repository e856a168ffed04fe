"""Words of many texts as 64-bit hashes, without a Python object per word.

Lower-cases A-Z; a word is a run of bytes outside space and 0x09-0x0D. A word's hash is a polynomial in
its bytes modulo 2^64, read off one running sum over the buffer, then mixed. Long words whose letters are arranged
to that end have equal polynomials modulo a power of two, so a word of more than LONG bytes gets a digest instead.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Separators for words of letters and digits: every other ASCII byte.
LETTERS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def word_spans(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased texts joined, word starts, word ends, word hashes, offsets): text i has words offsets[i]:offsets[i + 1]."""
    joined = b"\n".join(texts).translate(LOWER)
    none = np.zeros(0, np.int64)
    if not joined:
        return joined, none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64)
    buffer = np.frombuffer(joined, np.uint8)
    word = ~space[buffer]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return joined, starts, ends, span_hashes(buffer, starts, ends), offsets


def short_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = _BYTE) -> np.ndarray:
    """Mixed polynomials of spans, equal for equal contents wherever they stand; for spans known to be short."""
    sums = prefix_sums(buffer, table)
    return mix((sums[ends] - sums[starts]) * inverse_powers(len(buffer) + 1)[starts])


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = _BYTE) -> np.ndarray:
    """Hashes of spans of any length; buffer holds bytes, or with no table 64-bit values."""
    hashes = short_hashes(buffer, starts, ends, table)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def same_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int = 1 << 18) -> bool:
    """Whether every span of buffer has the contents of its span of other; compared a window at a time, a longer span by itself."""
    size = ends - starts
    if (size != stop - begin).any():
        return False
    for i in np.flatnonzero(size > window).tolist():
        if (buffer[starts[i] : ends[i]] != other[begin[i] : stop[i]]).any():
            return False
    size = np.where(size > window, 0, size)
    total = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + window, "right")))
        own = size[first:last]
        step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        if (buffer[step + np.repeat(starts[first:last], own)] != other[step + np.repeat(begin[first:last], own)]).any():
            return False
        first = last
    return True


def prefix_sums(buffer: np.ndarray, table: np.ndarray | None = _BYTE) -> np.ndarray:
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer if table is None else table[buffer]) * _power("up", len(buffer))[: len(buffer)], out=total[1:])
    return total


def inverse_powers(n: int) -> np.ndarray:
    return _power("down", n)


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    _, _, _, hashes, offsets = word_spans(texts, space)
    return hashes, offsets


_STEP = np.random.default_rng(12).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def gram(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at these distances from every start; the last max(places) starts have none."""
    n = len(words) - max(places)
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(places), np.uint64)
    for i, p in enumerate(places):
        total = total * _STEP[i % 64] + words[p : p + n]
    return mix(total)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    words, offsets = word_hashes(texts)
    if k > 1:
        long = gram(words, tuple(range(k)))
    else:
        long = mix(words * _STEP[0] + np.uint64(1))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            s = np.sort(long[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(gram(words[a:b], tuple(range(b - a))) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
