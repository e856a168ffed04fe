"""Language identification by a string kernel.

Texts are compared by the blended spectrum: the character 1- to 3-grams both hold, each counted once and hashed to a
fixed number of cells, over the geometric mean of what each holds. A Nyström basis of landmark texts turns the kernel into
a finite feature map, on which ridge regression gives one score a language; texts are scored in batches by two
matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import held_out, pieces, prepare, spread, with_columns, with_fields

CELLS = (1 << 10, 1 << 12, 1 << 13)  # of 1-, 2- and 3-grams
START = np.cumsum([0, *CELLS])
SAMPLE = 4096  # rows fitted on, taken in the order of a hash of doc_id
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
WINDOWS = (1 << 14, 1 << 10, 1 << 8)  # characters of the passages that `keep` judges; the shorter for texts that the longer do not tell
KEEP = 0.2  # share of the median lead of unfitted training rows from which a text is in a learned language


@dataclass(frozen=True)
class Model:
    """Landmark presences (landmark x cell), their sizes, the coefficients (landmark x language), and the least lead to keep."""

    languages: list[str]
    landmarks: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    least: float = 0.0


def presence(texts: list[str]) -> np.ndarray:
    """Which cells the n-grams of every lower-cased text fall into, as a 0/1 matrix of float32."""
    out = np.zeros((len(texts), START[-1]), np.float32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(min(3, len(c))):
            h = (h[: len(c) - n] + c[n:] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            bits = CELLS[n].bit_length() - 1
            out[i, START[n] + ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Normalised blended-spectrum kernel of presence rows with the landmarks; an empty text has zeros."""
    size = np.sqrt(np.maximum(x.sum(1, dtype=np.float64), 1))
    return (x @ landmarks.T) / size[:, None] / root


def lead(f: np.ndarray) -> np.ndarray:
    """By how much the best language of every row leads the second; with one language its own value."""
    f = np.sort(f, axis=1)
    return f[:, -1] - f[:, -2] if f.shape[1] > 1 else f[:, -1]


def _unpacked(cells: np.ndarray) -> np.ndarray:
    return np.unpackbits(cells, axis=1).astype(np.float32)


def _ridge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marks = _unpacked(x[:LANDMARKS])
    root = np.sqrt(np.maximum(marks.sum(1, dtype=np.float64), 1))
    values, vectors = np.linalg.eigh(kernel(marks, marks, root)) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
    good = values > 1e-8 * max(values.max(initial=0), 1e-300)
    basis = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([kernel(_unpacked(x[i : i + 512]), marks, root) @ basis for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, basis.shape[1]))
    w = np.linalg.solve(phi.T @ phi + RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    return marks, root, basis @ w


def fit(rows: list[tuple[bytes, str]]) -> Model:
    """Nyström kernel ridge regression, one language against the rest, on packed presences, of which 512 rows are unpacked at a time.

    The least lead is KEEP times the median lead of rows told right by a fit on the other half of the rows. A text unlike all
    landmarks has values near 0 and letter junk equally low ones, so both lead by little, whatever the values themselves.
    """
    x = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), START[-1] // 8)
    names = sorted({r[1] for r in rows})
    y = np.array([[1.0 if r[1] == n else -1.0 for n in names] for r in rows]).reshape(len(rows), len(names))
    leads = [np.zeros(0)]
    for half in (0, 1) if len(rows) > 1 else ():
        marks, root, weights = _ridge(x[half::2], y[half::2])
        other, truth = x[1 - half :: 2], y[1 - half :: 2].argmax(1)
        f = np.concatenate([kernel(_unpacked(other[i : i + 512]), marks, root) @ weights for i in range(0, len(other), 512)])
        leads.append(lead(f)[f.argmax(1) == truth])
    told = np.concatenate(leads)
    marks, root, weights = _ridge(x, y)
    return Model(names, marks.astype(np.uint8), root, weights, KEEP * float(np.median(told)) if len(told) else 0.0)


def _presences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        packed = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), pa.array(packed, pa.binary())], names=["order", "lang", "cells"])


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` rows that are not held out and have a letter and a language."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("key"), 4, 2))
    # the order's bound first, from ids alone, so that no text takes part in a sort
    order = F.xxhash64("key")
    known = docs.select(F.col(doc_id).alias("key"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("key"), 4, 2))
    bound = known.select(order.alias("order")).orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    if bound is None:
        return fit([])
    found = rows.withColumn("order", order).where(F.col("order") <= bound).select("order", "lang", "text").mapInArrow(
        _presences, "order bigint, lang string, cells binary").orderBy("order", "lang", "cells").limit(sample).collect()
    return fit([(r["cells"], r["lang"]) for r in found])


def with_language(docs: DataFrame, model: Model, name: str, score: str, text: str = "text") -> DataFrame:
    """docs with all columns and rows, and the language and its score in 0..1 under two names that docs must not have.

    A text that is null, empty or has no letter is `und` with score 0, as is everything if no row could be learned
    from. Ties go to the language that sorts first. Repeated rows get equal predictions, whole texts are read however long,
    and an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.landmarks, model.root, model.weights))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, marks, root, weights = shared.value
        marks = marks.astype(np.float32)
        for batch in pieces(batches, text):
            found, top = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            lettered = [i for i, c in enumerate(batch.column(name).to_pylist()) if c] if names else []
            if lettered:
                column = batch.column(text)
                f = kernel(presence([column[i].as_py() for i in lettered]), marks, root) @ weights
                for i, k in zip(lettered, f.argmax(1).tolist()):
                    found[i] = names[k]
                top[lettered] = np.clip((f.max(1) + 1) / 2, 0, 1)
            yield with_columns(batch.drop_columns([name]), {name: pa.array(found, pa.string()), score: pa.array(top)})

    # the new name first holds whether there is a letter at all
    marked = spread(docs).withColumn(name, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(scan, with_fields(docs, {name: "string", score: "double"}))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score in 0..1. Only the two named columns are read.

    Repeated rows and null ids are rows like any other; a null id counts as the empty text for held_out. Whole texts are read, however
    long, each alone in its batch if need be. An empty table gives no rows."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_language(raw, model, "lang_pred", "score").select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def passages(text: str, size: int) -> list[str]:
    """The text in equal parts of at most `size` characters; parts without a letter are left out."""
    n = max(-(-len(text) // size), 1)
    step = max(-(-len(text) // n), 1)
    return [p for i in range(0, len(text), step) if any(map(str.isalpha, p := text[i : i + step]))]


def leads(texts: list[str], size: int, marks: np.ndarray, root: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean lead over every text's passages, so that length does not blur it; without a letter minus infinity."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    row, part = [], []

    def add() -> None:
        if part:
            at = np.array(row)
            np.add.at(total, at, lead(kernel(presence(part), marks, root) @ weights))
            np.add.at(count, at, 1)
            row.clear()
            part.clear()

    for i, text in enumerate(texts):
        for p in passages(text, size):
            row.append(i)
            part.append(p)
            if len(part) == 256:
                add()
    add()
    return np.where(count > 0, total / np.maximum(count, 1), -np.inf)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs in a learned language, with their columns.

    They are those whose passages of some size in WINDOWS lead by model.least or more on the mean: long passages see past lines
    that repeat, short ones tell a text that changes between learned languages. Null, empty and letterless texts go, as
    does everything if no row could be learned from.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.landmarks, model.root, model.weights, model.least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, marks, *rest, least = shared.value
        marks = marks.astype(np.float32)
        for batch in pieces(batches, text):
            column = batch.column(text)
            known = np.zeros(batch.num_rows, bool)
            for size in WINDOWS if names else ():
                left = np.flatnonzero(~known)
                known[left] = leads([column[i].as_py() or "" for i in left.tolist()], size, marks, *rest) >= least
            yield batch.filter(pa.array(known))

    return spread(docs).mapInArrow(scan, docs.schema)
