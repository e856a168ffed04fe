"""Near-duplicate documents by SetSketch registers.

A document is the set of its k-word shingles. Register i of its sketch is the truncated floor(1 - log_b(x_i)) of
the least of exponentially distributed hash values x_i over the set, so the sketch of a union is the maximum of the
sketches. Bands of registers give candidates; the likelihood of the three joint register counts (larger, smaller,
equal) under the known set sizes drops a candidate only if a similarity at the threshold is out of
question; what remains is confirmed on the full shingle sets.

Nothing is emitted per pair. Documents with equal sets are one class. A bucket of a band is compared in blocks of
at most BLOCK classes and yields the spanning edges of its possible links, and for every class the edge with the most equal
registers. Full sets first meet along one edge a class, so that a set travels about once however large its group; true links
contract to parts. A bucket whose spanning edges all lie inside parts is done. In the others possible links between
different parts are listed again, and what they connect is compared on full sets in blocks, the largest part of a group
only with the rest of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import bipartite, components, cut, free_name, pieces, prepare, runs, sieve, spanning, spread, texts, with_maybe
from winnow.llm.wordhash import mix, shingle_sets

REGISTERS = 128
ROWS = 4  # registers a band: at similarity 0.8 a pair misses all 32 bands with probability 5e-8
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2
BLOCK = 1024
BLOCK_SHINGLES = 400_000
SURPLUS = 0.05  # by which the share of equal registers of a hub must exceed the similarity asked for
STAR_SHINGLES = 2_000_000  # shingles of the classes that meet a copy of the set at the other end of their edges
SURE = 12.0  # log likelihood ratio against the threshold from which a candidate is dropped

_rng = np.random.default_rng(21)
_LOW = _rng.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _rng.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row for every set; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) <= 16_384):
            size += len(sets[stop])
            stop += 1
        full = [i for i in range(start, stop) if len(sets[i])]
        if full:
            flat = np.concatenate([sets[i] for i in full])
            low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
            begin = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            least = np.empty((len(full), REGISTERS), np.uint32)
            for r in range(REGISTERS):
                least[:, r] = np.minimum.reduceat(low * _LOW[r] + high * _HIGH[r], begin)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
            out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
        start = stop
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of every row."""
    r = registers.astype(np.uint64) * _BAND
    keys = r.reshape(len(r), -1, ROWS).sum(2, dtype=np.uint64) + np.arange(REGISTERS // ROWS, dtype=np.uint64)
    return mix(keys).view(np.int64)


def _log_tail(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b): how likely one register exceeds the other by the share x of the union."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log likelihood of similarity j from the register counts; u is the left set's share of the summed sizes."""
    larger = np.maximum(_log_tail(u - (1 - u) * j), 1e-12)
    smaller = np.maximum(_log_tail((1 - u) - u * j), 1e-12)
    equal = np.maximum(1 - larger - smaller, 1e-12)
    return more * np.log(larger) + less * np.log(smaller) + same * np.log(equal)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether similarity `least` is plausible, how many registers are equal) for every pair of rows of a and b, as matrices."""
    same = np.zeros((len(a), len(b)), np.int16)
    more = np.zeros((len(a), len(b)), np.int16)
    for r in range(REGISTERS):
        same += a[:, r][:, None] == b[:, r]
        more += a[:, r][:, None] > b[:, r]
    fits = np.minimum(na[:, None], nb) >= least * np.maximum(na[:, None], nb) - 1e-9
    keep = fits & (same >= least * REGISTERS)
    i, k = np.nonzero(fits & ~keep & (same >= (least - 0.3) * REGISTERS))
    for s in range(0, len(i), 65_536):
        x, y = i[s : s + 65_536], k[s : s + 65_536]
        u = na[x] / (na[x] + nb[y])
        counts = more[x, y].astype(float), (REGISTERS - same[x, y] - more[x, y]).astype(float), same[x, y].astype(float)
        top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
        best = np.max([log_likelihood(top * f, u, *counts) for f in np.linspace(0.3, 1, 15)], axis=0)
        keep[x, y] = best - log_likelihood(np.minimum(least, top), u, *counts) <= SURE
    return keep, same


def _sketch(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = shingle_sets(texts(batch), k)
            registers = sketches(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("at"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())],
                names=["doc_id", "at", "n_shingles", "digest", "registers"])

    return scan


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(registers)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "keys"])


def _sets(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            sets = shingle_sets(texts(batch), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["digest", "n", "shingles"])

    return scan


def _edges(rows: pd.DataFrame, keys: list[str], link, likeliest: bool = False) -> pd.DataFrame:
    """Spanning edges of all blocks in rows; link(left, right) gives the links of two frames as a matrix.

    With likeliest, link also gives the numbers of equal registers, and the edges are named by the first key and come with that number; after
    them, with no key, every row's edge with the most equal registers.
    """
    rows = rows.sort_values([*keys, "digest"], kind="stable").reset_index(drop=True)
    digest, block = rows["digest"].to_numpy(), rows["block"].to_numpy()
    out: list[tuple] = []
    for start, stop in runs([rows[c].to_numpy() for c in keys]):
        part = rows.iloc[start:stop]
        ids, own = digest[start:stop], block[start:stop]
        i, j = part["i"].iat[0], part["j"].iat[0]
        left, right = (own == i, own == j) if i != j else (np.ones(len(ids), bool),) * 2
        if len(ids) < 2 or not left.any() or not right.any():
            continue
        found = link(part[left], part[right]) if i != j else link(part, part)
        linked, same = found if likeliest else (found, None)
        a, b = ids[left], ids[right]
        if i == j:
            label = spanning(linked)
            edges = [(x, int(label[x])) for x in np.flatnonzero(label != np.arange(len(label))).tolist()]
        else:
            edges = bipartite(linked)
        if not likeliest:
            out += [(a[x], b[y]) for x, y in edges]
            continue
        key = part[keys[0]].iat[0]
        # from the larger to the smaller digest, so that the classes of a group choose the same hub
        out += [(max(a[x], b[y]), min(a[x], b[y]), key, int(same[x, y])) for x, y in edges]
        score = np.where(linked, same, -1)
        if i == j:
            np.fill_diagonal(score, -1)  # a row is no partner of its own
        for names, others, m in ((a, b, score),) if i == j else ((a, b, score), (b, a, score.T)):
            best = m.argmax(1)
            out += [(names[x], others[best[x]], None, int(m[x, best[x]])) for x in np.flatnonzero(m.max(1) >= 0).tolist()]
    if not likeliest:
        return pd.DataFrame(out, columns=["a", "b"])
    a, b, key, same = zip(*out) if out else ((),) * 4
    # a column of numbers and nulls must not become one of doubles
    return pd.DataFrame({"a": a, "b": b, keys[0]: pd.array(key, dtype="Int64"), "same": pd.array(same, dtype="Int32")})


def _possible(least: float):
    """Possible links and equal registers of two frames; where rows have parts, links only between different ones."""

    def link(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        unpack = lambda f: np.frombuffer(b"".join(f["registers"]), np.uint16).reshape(-1, REGISTERS)
        out, same = possible(unpack(left), unpack(right), left["n"].to_numpy(float), right["n"].to_numpy(float), least)
        if "part" in left:
            every = np.unique([*left["part"], *right["part"]], return_inverse=True)[1]
            out &= every[: len(left), None] != every[len(left) :]
        return out, same

    return link


def _possible_edges(least: float):
    link = _possible(least)
    # classes whose ids meet come with each other's rows
    return lambda rows: _edges(rows.drop_duplicates(["key", "i", "j", "digest"]), ["key", "i", "j"], link, likeliest=True)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of presence matrices over the values both sides hold."""
    nl, nr = len(left), len(right)
    values = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(nl + nr), [len(s) for s in [*left, *right]])
    distinct, inverse = np.unique(values, return_inverse=True)
    on_left = np.bincount(inverse[rows < nl], minlength=len(distinct)) > 0
    on_right = np.bincount(inverse[rows >= nl], minlength=len(distinct)) > 0
    shared = on_left & on_right
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    rows, columns = rows[keep], place[inverse[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((nl, nr), np.float32)
    step = 4096
    for start in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(columns, (start, start + step))
        m = np.zeros((nl + nr, step), np.float32)
        m[rows[lo:hi], columns[lo:hi] - start] = 1
        out += m[:nl] @ m[nl:].T
    return out


def _true_edges(num: int, den: int):
    def link(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        unpack = lambda f: [np.frombuffer(s, np.uint64) for s in f["shingles"]]
        a, b = unpack(left), unpack(right)
        if left is right:
            # a value that one document alone holds cannot count for a pair
            values, counts = np.unique(np.concatenate(a), return_counts=True)
            single = values[counts == 1]
            a = b = [s[~np.isin(s, single, assume_unique=True)] for s in a] if len(single) else a
        common = np.rint(intersections(a, b)).astype(np.int64)
        union = left["n"].to_numpy()[:, None] + right["n"].to_numpy() - common
        out = den * common >= num * union
        if left is right:
            np.fill_diagonal(out, False)
        return out

    return lambda rows: _edges(rows.drop_duplicates(["component", "i", "j", "digest"]), ["component", "i", "j"], link)


def _star_edges(num: int, den: int):
    """True links of classes to the hub that their rows name: one sorted search of all their shingles in the hub's."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hub", "block", "leaf", "digest"], kind="stable").reset_index(drop=True)
        a, b = [], []
        for start, stop in runs([rows[c].to_numpy() for c in ("hub", "block")]):
            part = rows.iloc[start:stop]
            leaves = part[part["leaf"]]
            if not len(leaves) or part["leaf"].iat[0]:
                continue
            hub = np.frombuffer(part["shingles"].iat[0], np.uint64)
            sets = [np.frombuffer(s, np.uint64) for s in leaves["shingles"]]
            flat = np.concatenate(sets)
            at = np.searchsorted(hub, flat)
            shared = hub[np.minimum(at, len(hub) - 1)] == flat
            sizes = np.array([len(s) for s in sets])
            common = np.add.reduceat(shared.astype(np.int64), np.cumsum(sizes) - sizes)
            linked = den * common >= num * (len(hub) + sizes - common)
            a += leaves["digest"].to_numpy()[linked].tolist()
            b += [part["hub"].iat[0]] * int(linked.sum())
        return pd.DataFrame({"a": a, "b": b})

    return work


def _along(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those edges (a, b), at most one for every a, that are true links; b's set travels once for every STAR_SHINGLES of the sets it meets."""
    sizes = sets.select(F.col("digest").alias("a"), "n")
    each = edges.join(sizes, "a").groupBy("b").agg(F.ceil(F.sum("n") / STAR_SHINGLES).alias("blocks"), F.sum("n").alias("met"))
    each = cut(each)
    dealt = edges.join(each.select("b", "blocks"), "b").select(
        F.col("b").alias("hub"), F.pmod(F.xxhash64("a", F.lit(5)), F.col("blocks")).alias("block"), F.col("a").alias("digest"), F.lit(True).alias("leaf"))
    hubs = each.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
                       F.col("b").alias("digest"), F.lit(False).alias("leaf"))
    # written down, so that its size is known before the sets are joined to it
    rows = cut(dealt.unionByName(hubs)).join(sets.select("digest", "shingles"), "digest")
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-_weight(each, F.col("met")) // 1_000_000))
    return rows.groupBy(F.pmod(F.xxhash64("hub", "block", F.lit(3)), F.lit(n)).alias("bundle")).applyInPandas(_star_edges(num, den), "a binary, b binary")


def _grid(rows: DataFrame, blocks: str) -> DataFrame:
    """Deal the rows of every key to blocks by their id, and every block to the cells (i, j) of the grid it meets."""
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    )


def _part_grid(rows: DataFrame) -> DataFrame:
    """The same for members (component, digest, n, part): blocks of a component's largest part meet only those of its other parts."""
    sizes = cut(rows.groupBy("component", "part").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members")))
    largest = sizes.groupBy("component").agg(F.max(F.struct("shingles", "part")).alias("m"), F.sum("shingles").alias("all"), F.sum("members").alias("number"))
    main = sizes.join(largest.select("component", F.col("m.part").alias("part"), "all", "number"), ["component", "part"])
    blocks = lambda members, shingles: F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    counts = main.select(
        "component", F.col("part").alias("main"), blocks(F.col("members"), F.col("shingles")).alias("mains"),
        blocks(F.col("number") - F.col("members"), F.col("all") - F.col("shingles")).alias("rest"))
    of = F.xxhash64("digest", F.lit(7))
    in_main = F.col("part") == F.col("main")
    dealt = rows.join(counts, "component").withColumn(
        "block", F.when(in_main, F.col("rest") + F.pmod(of, F.col("mains"))).otherwise(F.pmod(of, F.col("rest"))).cast("int"))
    last = F.when(in_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "component", "digest", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _weight(rows: DataFrame, each: Column) -> int:
    """The sum of a weight over all rows; in a grid a row counts once for every block it is dealt to."""
    return int(rows.agg(F.sum(each)).first()[0] or 0)


def _bundle(rows: DataFrame, key: str, weight: int, per: int, work, schema: str) -> DataFrame:
    """Apply work to bundles of whole grid cells, each bundle holding about `per` units of weight."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-weight // per))
    return rows.groupBy(F.pmod(F.xxhash64(key, "i", "j", F.lit(3)), F.lit(n)).alias("bundle")).applyInPandas(work, schema)


def _with_part(rows: DataFrame, parts: DataFrame, name: str, out: str = "part") -> DataFrame:
    """rows with the part of the class in column `name`: its component of true links, or itself."""
    own = parts.select(F.col("node").alias(name), F.col("component").alias(out))
    return rows.join(own, name, "left").withColumn(out, F.coalesce(out, name))


def _apart(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between different parts."""
    return _with_part(_with_part(edges, parts, "a", "part_a"), parts, "b", "part_b").where("part_a <> part_b")


def _groups(docs: DataFrame, k: int, num: int, den: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, at, n_shingles, digest, registers; classes: digest, least_id and more; links: node and component, of linked classes)."""
    spark = prepare(docs.sparkSession)
    least = num / den
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = raw.withColumn("at", F.xxhash64("text"))
    rows = cut(spread(named).mapInArrow(
        _sketch(k), f"doc_id {dict(raw.dtypes)['doc_id']}, at bigint, n_shingles bigint, digest binary, registers binary"))
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n"),
        F.min(F.struct(F.isnull("doc_id"), "doc_id", "at")).alias("one")))

    # classes that meet another class in a band; most meet none, so a count alone is taken of all keys, and a class travels as 64 bits
    of = F.xxhash64("digest").alias("id")
    bands = classes.select(of, "registers").mapInArrow(_keys, "id bigint, keys array<bigint>").select("id", F.explode("keys").alias("key"))
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut(bands.join(full, "key"))
    # classes that share several bands meet once: of buckets with the same members, told by two digests over them, one stays
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    buckets = met.groupBy("key", "size").agg(*marks).groupBy("size", "mark1", "mark2").agg(F.min("key").alias("key")).select("key")
    met = cut(met.join(buckets, "key", "left_semi")).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    traits = classes.select(of, "digest", "registers", "n")
    grid = _grid(met, "blocks").join(traits, "id").select("key", "i", "j", "block", "digest", "registers", "n")
    edge = f"a binary, b binary, key {dict(met.dtypes)['key']}, same int"
    found = cut(_bundle(grid, "key", _weight(met, F.col("blocks")), 20_000, _possible_edges(least), edge))
    # one edge for every class: to a hub that looks similar enough, of which a whole group may be; otherwise to the likeliest partner
    hub = F.col("key").isNotNull() & (F.col("same") >= math.ceil((least + SURPLUS) * REGISTERS))
    pick = cut(found.groupBy("a").agg(F.coalesce(F.min(F.when(hub, F.col("b"))), F.max_by("b", F.struct("same", "b"))).alias("b")))
    if pick.isEmpty():
        return rows, classes, components(spark.createDataFrame([], "a binary, b binary"))

    # full sets of the classes at these edges
    ends = pick.select(F.col("a").alias("digest")).union(pick.select("b")).distinct()
    wanted = cut(classes.join(ends, "digest").select("digest", F.col("one.doc_id").alias("w_id"), F.col("one.at").alias("w_at")))
    near = with_maybe(named, "at", sieve(wanted, "w_at"), "maybe").where("maybe")
    sets = cut(near.join(wanted, near["doc_id"].eqNullSafe(wanted["w_id"]) & (near["at"] == wanted["w_at"]), "left_semi").select("text").mapInArrow(
        _sets(k), "digest binary, n bigint, shingles binary"), "none")
    true = cut(_along(pick, sets, num, den))
    parts = components(true)

    # buckets with a spanning edge between parts
    found = found.where("key is not null").select("a", "b", "key")

    def across(parts: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
        own = parts.select(F.xxhash64("node").alias("id"), "node", F.col("component").alias("part"))
        rest = cut(met.join(keys, "key", "left_semi").join(own, "id", "left"))
        part = F.coalesce(F.when(F.col("node") == F.col("digest"), F.col("part")), "digest").alias("part")
        return _grid(rest, "blocks").join(traits, "id").select("key", "i", "j", "block", "digest", part, "registers", "n"), _weight(rest, F.col("blocks"))

    # all that possible links between parts connect is compared on full sets
    keys = cut(_apart(found, parts).select("key").distinct())
    if keys.isEmpty():
        return rows, classes, parts
    cells, weight = across(parts, keys)
    groups = components(_bundle(cells, "key", weight, 20_000, _possible_edges(least), edge).where("key is not null").select("a", "b"))
    members = groups.select("component", F.col("node").alias("digest")).join(sets.select("digest", "n").distinct(), "digest")
    placed = cut(_part_grid(_with_part(members, parts, "digest")))
    more = _bundle(sets.join(placed.drop("n"), "digest").select("component", "i", "j", "block", "digest", "n", "shingles"),
                   "component", _weight(placed, F.col("n")), 500_000, _true_edges(num, den), "a binary, b binary")
    linked = components(true.unionByName(more))

    return rows, classes, linked


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group documents whose k-word shingle sets have a Jaccard similarity of at least num / den.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)
    and kept (doc_id is component_id). Text null, empty or without a word: no shingles, linked with nothing, kept. A
    null doc_id takes part: its component is named by the least non-null id; a group with null ids only has a null
    component_id and is kept. Repeated rows are links like any other and carry equal ids, so that all of them are
    kept or none. Only the two named columns are read; an empty table gives no rows.
    """
    rows, classes, linked = _groups(docs, k, num, den, text, doc_id)
    ids = linked.join(classes.select(F.col("digest").alias("node"), "least_id"), "node")
    first = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    single = classes.join(linked.select(F.col("node").alias("digest")), "digest", "left_anti").select("digest", F.col("least_id").alias("component_id"))
    named_by = ids.join(first, "component").select(F.col("node").alias("digest"), "component_id").unionByName(single)
    has = rows.where("digest is not null").join(named_by, "digest").select("doc_id", "n_shingles", "component_id")
    none = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return has.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.isnull("component_id")))


def survivors(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without all but one row of every group of near-duplicates, with their columns.

    The row with the least doc_id stays (null ids last, then the least hash of the text). Rows without a word are in no group
    and stay. Of repeated rows with a word one stays.
    """
    rows, classes, linked = _groups(docs, k, num, den, text, doc_id)
    members = classes.join(linked, classes["digest"] == linked["node"], "left").select(
        "digest", F.coalesce("component", "digest").alias("component"), "one")
    picks = members.groupBy("component").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("p_id"), F.col("one.at").alias("p_at"))
    worded = rows.where("digest is not null").groupBy("doc_id", "at").agg(F.count(F.lit(1)).alias("times"))
    same = worded["doc_id"].eqNullSafe(picks["p_id"]) & (worded["at"] == picks["p_at"])
    gone = cut(worded.join(picks, same, "left_anti").select(F.col("doc_id").alias("g_id"), F.col("at").alias("g_at")))
    name = free_name(docs, "at")
    marked = docs.withColumn(name, F.xxhash64(text))
    # rows that are surely no member of `gone` stay where they are. Of the others ids and hashes alone meet it, most of them being
    # members, and what is left of these tells the rows that stay
    both, flag = (free_name(marked, n) for n in ("both", "maybe"))
    marked = with_maybe(marked.withColumn(both, F.xxhash64(doc_id, name)), both, sieve(gone.select(F.xxhash64("g_id", "g_at").alias("of")), "of"), flag)
    asked = marked.where(F.col(flag)).drop(flag)
    keys = asked.select(F.col(doc_id).alias("s_id"), F.col(name).alias("s_at"))
    stay = cut(keys.join(gone, keys["s_id"].eqNullSafe(gone["g_id"]) & (keys["s_at"] == gone["g_at"]), "left_anti").distinct())
    asked = with_maybe(asked, both, sieve(stay.select(F.xxhash64("s_id", "s_at").alias("of")), "of"), flag).where(F.col(flag)).drop(flag)
    kept = asked.join(stay, asked[doc_id].eqNullSafe(stay["s_id"]) & (asked[name] == stay["s_at"]), "left_semi")
    left = marked.where(~F.col(flag)).drop(flag).unionByName(kept).drop(both)
    if not worded.where("times > 1").isEmpty():
        worded_row = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.where(worded_row).dropDuplicates([doc_id, name]).unionByName(left.where(~worded_row))
    return left.drop(name)
