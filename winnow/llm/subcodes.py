"""Vector codes from one integer codebook a part, fitted by exact rounds with norm-of-sum bounds.

A vector becomes integers and is cut into equal parts; each part has a codebook of up to 256 entries. A round assigns every part
to its nearest entry and replaces the entries by the floored means of their parts. All arithmetic that decides a result is on whole
numbers, so rows, partitions and machines may come in any order.

Entries form a few groups a part. For every row, part and group one lower bound of the distance to the group's entries other than the
assigned one is kept, with the round at which it was found. No bound is ever worn down round by round: the codebooks of all rounds
are kept, and what a bound of round s loses by now is the true distance between an entry then and now (a norm of a sum of moves, not
the sum of their norms). Only groups whose bound falls to the exact distance of the assigned entry are scanned again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from winnow.llm.common import cut, prepare, spread

GROUPS = 8
LIMIT = 32_768.0  # components of at least this size have no place in a 64-bit sum of squares
_SLACK = 1e-5  # relative, against rounding of stored 32-bit bounds


def cuts(d: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of d components begin and end: consecutive, the first ones a component longer where d is no multiple."""
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(d), parts)]).tolist()
    return list(zip([0, *ends], ends))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows of x and c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < 1 << 53:  # every intermediate is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def entry_groups(c: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """The entries of a codebook by the nearest of `groups` entries that lie far apart; any grouping gives the same codes."""
    seeds = [0]
    far = squares(c, c[:1])[:, 0]
    while len(seeds) < min(groups, len(c)):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, squares(c, c[seeds[-1:]])[:, 0])
    own = squares(c, c[seeds]).argmin(1)
    return [np.flatnonzero(own == g) for g in range(len(seeds)) if (own == g).any()]


class Bounded:
    """Nearest entries of one part over the rounds of its codebook; history[s] is the codebook of round s."""

    def __init__(self, history: list[np.ndarray], groups: list[np.ndarray]):
        self.history, self.groups, self.now = history, groups, len(history) - 1
        self.group_of = np.zeros(len(history[0]), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        current = history[-1]
        # moved[g, s]: the farthest that an entry of group g stands from where it stood at round s
        self.moved = np.array([[np.sqrt(((current[m] - old[m]) ** 2).sum(1).max()) for old in history] for m in groups])
        self.rescanned = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared distances, bounds, stamps) from a scan of all entries."""
        far = squares(x, self.history[-1])
        code = far.argmin(1)
        error = far[np.arange(len(x)), code]
        bound = np.zeros((len(x), len(self.groups)), np.float32)
        for g, members in enumerate(self.groups):
            bound[:, g] = self._least(far[:, members], members, code)
        return code, error, bound, np.full(bound.shape, self.now, np.uint8)

    def again(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for rows with codes and bounds of earlier rounds; scans only groups whose bound does not exclude them."""
        old, current = code, self.history[-1]
        code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
        error = ((x - current[old]) ** 2).sum(1)
        before = error.copy()
        lower = bound * (1 - _SLACK) - self.moved[np.arange(len(self.groups)), stamp] * (1 + _SLACK)
        open_ = lower <= np.sqrt(before)[:, None] * (1 + _SLACK)  # a bound at the distance itself may hide a tie of lower index
        scans = []
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(open_[:, g])
            if len(rows):
                far = squares(x[rows], current[members])
                scans.append((g, rows, far))
                self.rescanned += len(rows) * len(members)
                best = far.argmin(1)
                least, entry = far[np.arange(len(rows)), best], members[best]
                better = (least < error[rows]) | ((least == error[rows]) & (entry < code[rows]))
                code[rows[better]], error[rows[better]] = entry[better], least[better]
        # the entry that was left counts for its group from now on
        left = np.flatnonzero(code != old)
        g = self.group_of[old[left]]
        bound[left, g] = np.maximum(np.minimum(lower[left, g], np.sqrt(before[left]) * (1 - _SLACK)), 0)
        stamp[left, g] = self.now
        for g, rows, far in scans:
            bound[rows, g], stamp[rows, g] = self._least(far, self.groups[g], code[rows]), self.now
        return code, error, bound, stamp

    @staticmethod
    def _least(far: np.ndarray, members: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The least distance to members other than the assigned one; infinite if there is none."""
        far = np.where(members == code[:, None], np.inf, far.astype(np.float64))
        return np.sqrt(far.min(1))


def _numbers(column: pa.Array, d: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, d)


def _round(shared, ranges: list[tuple[int, int]], first: bool, last: bool, kinds: list[pa.DataType]):
    """One pass: new codes, errors and bounds of all rows, then, unless it is the last pass, a task's sums by part and entry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, groups = shared.value
        work = [Bounded(h, g) for h, g in zip(history, groups)]
        sums = [np.zeros((len(w.history[0]), b - a), np.int64) for w, (a, b) in zip(work, ranges)]
        counts = [np.zeros(len(w.history[0]), np.int64) for w in work]
        sizes = [len(w.groups) for w in work]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column("x"), ranges[-1][1], np.int64)
            n = len(x)
            if not first:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, -1)
                stamps = np.frombuffer(b"".join(batch.column("stamps").to_pylist()), np.uint8).reshape(n, -1)
            done, at = [], 0
            for p, (w, (a, b)) in enumerate(zip(work, ranges)):
                own = slice(at, at + sizes[p])
                part = x[:, a:b]
                done.append(w.first(part) if first else w.again(part, codes[:, p].astype(np.int64), bounds[:, own], stamps[:, own]))
                at += sizes[p]
                if not last:
                    code = done[-1][0]
                    order = np.argsort(code, kind="stable")
                    met, begin = np.unique(code[order], return_index=True)
                    sums[p][met] += np.add.reduceat(part[order], begin, axis=0)
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
            code, bound, stamp = (np.ascontiguousarray(np.concatenate([np.asarray(r[i]).reshape(n, -1) for r in done], axis=1), kind)
                                  for i, kind in ((0, np.uint8), (2, np.float32), (3, np.uint8)))
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in code], pa.binary())]
            if last:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sum(r[1] for r in done), pa.int64())], names=["vec_id", "label", "code", "error"])
                continue
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("x"), pa.array([r.tobytes() for r in bound], pa.binary()), pa.array([r.tobytes() for r in stamp], pa.binary()), *empty],
                names=_NAMES)
        if not last:
            rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(work)) for e in np.flatnonzero(counts[p]).tolist()]
            if rows:
                own = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in kinds), *own], names=_NAMES)

    return scan


_NAMES = ["vec_id", "label", "code", "x", "bounds", "stamps", "part", "entry", "n", "sums"]


def kept(vector: Column) -> Column:
    """Not null, and neither a null nor a non-finite component."""
    inside = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vector.isNotNull() & inside


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
        vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per coded row: vec_id, label, code (a byte a part), error (squared distances summed over parts); the final codebooks).

    Every component x becomes floor(scale * x). A part's codebook starts as that part of the `entries` smallest vec_ids (repeated ids in
    the order of their vectors, null ids last); each round assigns all parts to the nearest entry, ties to the lower index, and replaces
    every entry that has parts by the floored mean of these. After the rounds the parts are assigned once more.

    Rows whose vector is null or holds a null or non-finite component have no code and no row; nor have rows whose vector has
    another length than that of the smallest id, or a component of 32,768 or more, of which the squares overflow. Null ids and
    repeated rows are rows like any other. With fewer rows than entries the codebook is that short; an empty table gives no rows
    and empty codebooks. Only the three named columns are read.

    Every pass reads the table that the pass before wrote and brings back one sum per part and entry; the driver holds only codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"entries must be from 1 to 256, not {entries}")
    spark = prepare(vectors.sparkSession)
    raw = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    raw = raw.where(kept(F.col("v")) & (F.size("v") > 0) & F.forall("v", lambda c: F.abs(c) < LIMIT))
    rows = raw.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    kinds = dict(rows.dtypes)
    final = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint"
    if not smallest:
        return spark.createDataFrame([], final), [np.zeros((0, 0), np.int64)] * parts
    d = len(smallest[0]["x"])
    rows = spread(rows.where(F.size("x") == d))
    start = np.array([r["x"] for r in smallest if len(r["x"]) == d], np.int64)
    if len(start) < len(smallest):
        start = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], np.int64)
    ranges = cuts(d, parts)
    history = [[start[:, a:b]] for a, b in ranges]
    groups = [entry_groups(h[0]) for h in history]
    state = (f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, x array<int>, bounds binary, stamps binary, "
             "part int, entry int, n bigint, sums array<bigint>")
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(state))][:6]
    for t in range(rounds):
        table = cut(rows.mapInArrow(_round(spark.sparkContext.broadcast((history, groups)), ranges, t == 0, False, types), state))
        width = max(b - a for a, b in ranges)
        totals = table.where("part is not null").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
        for h in history:
            h.append(h[-1].copy())
        for r in totals:
            size = ranges[r["part"]][1] - ranges[r["part"]][0]
            history[r["part"]][-1][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
        rows = table.where("part is null")
    work = _round(spark.sparkContext.broadcast((history, groups)), ranges, rounds == 0, True, types)
    return rows.mapInArrow(work, final), [h[-1] for h in history]


def spell_codebooks(codebooks: list[np.ndarray]) -> str:
    """All components as decimal numbers, by part, entry and position, joined by commas."""
    return ",".join(str(v) for c in codebooks for e in c.tolist() for v in e)


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors summed over equal labels, null labels together."""
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
