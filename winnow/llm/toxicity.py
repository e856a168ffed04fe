"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct 32-bit hashes of its words, word pairs and pairs with one or two words between them. Some
hundred of 2^32 have a weight, so a million other features meet about one in ten times by chance. Training sees the examples one by one
with a learning rate for every feature; the L1 term leaves most weights at zero, so the model is a short list of features
that is broadcast. A text scores as its highest window of 1,024 words, so that weights do not add up with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import free_name, held_out, pieces, prepare, spread, texts, with_columns, with_fields
from winnow.llm.wordhash import LETTERS, gram, word_hashes

WINDOW = 1024  # words; windows start every half of it
BITS = 32
FILTER = 16  # leading bits of a feature that tell most features without a weight
SAMPLE = 8192  # labelled rows fitted on, taken in the order of a hash of doc_id
PLACES = ((0,), (0, 1), (0, 2), (0, 3))
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """The features with non-zero weights, in rising order, and these."""

    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(batch: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, feature) of every feature occurrence in the texts, of those whose leading bits are wanted, and the rows' numbers of words."""
    words, offsets = word_hashes(batch, LETTERS)
    rows, at, found = [], [], []
    row_of = np.repeat(np.arange(len(batch)), np.diff(offsets))
    for salt, places in enumerate(PLACES):
        g = gram(words, places) + np.uint64(salt)
        last = max(places)
        take = row_of[: len(g)] == row_of[last : last + len(g)]
        g = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32)
        if wanted is not None:
            take &= wanted[g >> np.uint32(BITS - FILTER)]
        take = np.flatnonzero(take)
        rows.append(row_of[take])
        at.append(take - offsets[row_of[take]])
        found.append(g[take])
    return np.concatenate(rows), np.concatenate(at), np.concatenate(found), np.diff(offsets)


def _frequent(examples: list[np.ndarray], more: float) -> np.ndarray:
    names, count = np.unique(np.concatenate(examples), return_counts=True)
    return names[count > more]


def fit(examples: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0, epochs: int = 4) -> Model:
    """FTRL-proximal over (distinct features in rising order, label) in the given order; without both labels a constant of their share."""
    share = (sum(y for _, y in examples) + 0.5) / (len(examples) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    if len({y for _, y in examples}) < 2:
        return Model(bias, np.zeros(0, np.uint32), np.zeros(0))
    # a gradient is at most 1, so that z of a feature of fewer examples never passes l1 and its weight stays zero
    ranges = np.linspace(0, 1 << BITS, 33)
    cuts = [np.searchsorted(f, ranges) for f, _ in examples]
    names = np.concatenate([_frequent([f[c[i] : c[i + 1]] for c, (f, _) in zip(cuts, examples)], l1 / epochs) for i in range(32)])
    known = []
    for found, y in examples:
        at = np.searchsorted(names, found)
        at[at == len(names)] = 0
        known.append((at[names[at] == found].astype(np.int32) if len(names) else at[:0], y))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(epochs):
        for cells, y in known:
            zi, ni = z[cells], n[cells]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            z[cells] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[cells] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w)
    return Model(bias, names[index], w[index])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, _, found, _ = features(texts(batch))
        order = np.argsort(rows, kind="stable")
        at = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        found = found[order]
        packed = [np.unique(found[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.array(packed, pa.binary())], names=["order", "y", "cells"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` labelled rows that are not held out; rows with a null id or label teach nothing."""
    prepare(docs.sparkSession)
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id), 3, 1))
        .select(F.col(doc_id).alias("key"), F.col(label).cast("int").alias("y")).distinct()
        .select("key", "y", F.xxhash64("key").alias("order")).orderBy("order", "key", "y").limit(sample)
    )
    rows = (
        docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
        .mapInArrow(_featurize, "order bigint, y int, cells binary")
        .orderBy("order", "y", "cells").limit(sample).collect()
    )
    return fit([(np.frombuffer(r["cells"], np.uint32), r["y"]) for r in rows])


def _totals(model, batch: list[bytes]) -> np.ndarray:
    """The highest score of every text's windows of WINDOW words; a text of no more words is one window."""
    bias, index, weight = model
    rows, at, found, words = features(batch, _wanted(index.tobytes()))
    place = np.minimum(np.searchsorted(index, found), max(len(index) - 1, 0))
    hit = index[place] == found if len(index) else np.zeros(0, bool)
    rows, at, place = rows[hit], at[hit], place[hit]
    # windows of all texts in one numbering; a word lies in the window that starts in its half and in the one before
    half = WINDOW // 2
    windows = 1 + np.maximum(-(-(words - WINDOW) // half), 0)
    start = np.concatenate(([0], np.cumsum(windows)))
    late, early = at // half, at // half - 1
    inside, before = late < windows[rows], early >= 0
    pair = np.concatenate((start[rows[inside]] + late[inside], start[rows[before]] + early[before]))
    both = np.unique(pair * max(len(index), 1) + np.concatenate((place[inside], place[before])))
    total = np.bincount(both // max(len(index), 1), weight[both % max(len(index), 1)] if len(index) else None, start[-1])
    best = np.maximum.reduceat(total, start[:-1]) if len(batch) else total
    return 1 / (1 + np.exp(-np.clip(bias + best, -35, 35)))


@lru_cache(2)
def _wanted(index: bytes) -> np.ndarray:
    wanted = np.zeros(1 << FILTER, bool)
    wanted[np.frombuffer(index, np.uint32) >> np.uint32(BITS - FILTER)] = True
    return wanted


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs with all columns and rows, and the score in 0..1 as column `name`, which docs must not have. Null and empty texts get the bias alone."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.bias, model.index.astype(np.uint32), model.weight.astype(np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield with_columns(batch, {name: pa.array(_totals(shared.value, texts(batch, text)))})

    return spread(docs).mapInArrow(scan, with_fields(docs, {name: "double"}))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score in 0..1 and predicted (1 from 0.7 up, 0.7 itself included). Only the two named columns are read.

    Repeated rows get equal scores, null ids count as the empty text for held_out, and an empty table gives no rows."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_score(raw, model, "score").select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    name = free_name(docs, "toxicity")
    return with_score(docs, model, name, text).where(F.col(name) < THRESHOLD).drop(name)
