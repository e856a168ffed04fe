"""Chat formatting as prefix trees: turns that conversations share from their start are emitted once.

A turn reads `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break; the two marks are ids after the vocabulary. In
roles and texts a `<` that backslashes and a `|` follow gets one backslash more, so that no text spells a mark, and reading takes it away again.

A node is a distinct beginning of conversations, named by a chained digest of its turns. Conversations are sorted by the nodes at which their
paths branch; that is the depth-first order of all trees, and a conversation contributes the run of nodes that none before it has. A tree's
runs, one after another, are its token stream. A run continues its parent node, so all of its tokens see the same earlier
intervals of the stream (its ancestors, neighbouring ones joined) and then the run itself; positions count along the path.

No conversation and no tree is gathered: digests are chained in blocks of turns, the sort key of a conversation holds only its
branchings (with n turns in the table no more than about the root of 2 n), and offsets are running sums that split hot trees.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.bytepair import encode_batch, encoder, vocabulary
from winnow.llm.common import cut, pieces, prepare, spread
from winnow.plans.ordered import with_row_number, with_running_sum

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK = 4096  # turns whose digests are chained in one go


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: line breaks and backslashes are spelled out first."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Trees:
    """The output of grow(), three tables in the checkpoint folder, of which `nodes` is in the order of the streams.

    nodes: tree, run, depth (from 1), start (its first token's place in the tree's stream), position (the first token's position id; the
    others follow), n_tokens, ids (little-endian 32-bit), loss_start and loss_stop (tokens of the node under the loss mask).
    runs: tree, run, start, stop (place in the stream), position, ancestors (array of start, stop: what all its tokens see
    besides the run up to themselves).
    turns: conv_id, key (the conversation's own name, for null ids as well), depth, tree, start (the node of that turn).
    """

    nodes: DataFrame
    runs: DataFrame
    turns: DataFrame


def _h(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key, block and depth: a digest of the block's turns so far, and the one before it."""
    last, digest = None, b""
    for batch in batches:
        own, before = [], []
        for name in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), batch.column("content").to_pylist()):
            if name[:2] != last:
                last, digest = name[:2], b""
            before.append(digest or None)
            digest = _h(digest, name[2])
            own.append(digest)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(own, pa.binary()), pa.array(before, pa.binary())], names=[*batch.schema.names, "own", "before"])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and block, one a block: the digest of all blocks before, and the node that ends them."""
    last, total, node = None, b"", None
    for batch in batches:
        totals, nodes = [], []
        for key, digest in zip(batch.column("key").to_pylist(), batch.column("own").to_pylist()):
            if key != last:
                last, total, node = key, b"", None
            totals.append(total)
            nodes.append(node)
            node = _h(total, digest) if total else digest
            total = _h(total, digest)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(totals, pa.binary()), pa.array(nodes, pa.binary())],
                                         names=["key", "block", "total", "ended"])


def _rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of later blocks: the digest of all blocks before and the block's own."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("own", "before", "total", "ended"))))
        node = [_h(t, o) for o, _, t, _ in rows]
        parent = [e if b is None else _h(t, b) for _, b, t, e in rows]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _TURN), pa.array(node, pa.binary()), pa.array(parent, pa.binary())], names=[*_TURN, "node", "parent"])


_TURN = ["key", "conv_id", "depth", "content"]


def _walk(base: DataFrame, conv: str) -> DataFrame:
    """(key, conv_id, depth, content, node, parent) of every turn; parent is null at depth 1."""
    slim = base.select("key", "conv_id", "turn", "content")
    rows = with_row_number(slim, ["key"], [F.asc_nulls_first("turn"), F.col("content")], "depth")
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    sorted_ = rows.select(*_TURN, "block").repartition("key", "block").sortWithinPartitions("key", "block", "depth")
    fields = f"key string, conv_id {conv}, depth bigint, content binary, block bigint"
    local = cut(sorted_.mapInArrow(_chain, f"{fields}, own binary, before binary"))
    first = local.where("block = 0").select(*_TURN, F.col("own").alias("node"), F.col("before").alias("parent"))
    later = local.where("block > 0")
    if later.isEmpty():
        return first
    long = later.select("key").distinct()
    ends = local.join(long, "key", "left_semi").groupBy("key", "block").agg(F.max_by("own", "depth").alias("own"))
    carry = ends.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_carry, "key string, block bigint, total binary, ended binary")
    return first.unionByName(later.join(carry, ["key", "block"]).mapInArrow(
        _rename, f"key string, conv_id {conv}, depth bigint, content binary, node binary, parent binary"))


def _encode(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, top = encoder(shared.value), len(vocabulary(shared.value)[1]) - 1
        (line,) = encode_batch(["\n"], cache)
        for batch in pieces(batches):
            rows = list(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()))
            parts = encode_batch([p for role, text in rows for p in (escape_role(role) + "\n", escape(text))], cache)
            ids, loss = [], []
            for (role, _), head, body in zip(rows, parts[::2], parts[1::2]):
                ids.append(np.concatenate([[top], head, body, [top + 1], line]).astype("<u4"))
                loss.append((1 + len(head), 1 + len(head) + len(body)) if role == LOSS_ROLE else (0, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                 *(pa.array([x[k] for x in loss], pa.int64()) for k in (0, 1))], names=["content", "n_tokens", "ids", "loss_start", "loss_stop"])

    return scan


def _joined(intervals):
    """Sorted intervals, neighbouring ones as one."""
    end = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] == x["start"]), longer).otherwise(F.concat(done, F.array(x)))

    empty = F.filter(F.coalesce(end, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop")))), lambda _: F.lit(False))
    return F.aggregate(intervals, empty, add)


def grow(conversations: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Trees:
    """Merge conversations into prefix trees of token ids, by the ranks in the file at `path`; see Trees.

    A conversation is the rows of one conv_id in the order of turn (null first), and of role and text where turns repeat. Null
    roles and texts are empty; rows with a null conv_id are one conversation; repeated rows are turns of their own. The texts of role
    `assistant` are under the loss mask. An empty table gives empty tables. Only the four named columns are read. The rank file
    is read by the driver and broadcast: its size is that of a vocabulary.
    """
    spark = prepare(conversations.sparkSession)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    conv = dict(conversations.dtypes)[conv_id]
    base = spread(conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    base = base.withColumn("content", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))

    # every distinct turn is encoded once
    distinct = base.groupBy("content").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    contents = cut(distinct.mapInArrow(_encode(shared), "content binary, n_tokens bigint, ids binary, loss_start bigint, loss_stop bigint"))

    walk = cut(_walk(base, conv))
    nodes = cut(walk.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("content").alias("content"),
                                         F.count(F.lit(1)).alias("times")))

    # a path changes its times where others branch off or end; these nodes are the sort key of a conversation
    up = nodes.select(F.col("node").alias("parent"), F.col("times").alias("above"))
    turning = nodes.join(up, "parent", "left").where("above is null or above <> times").select("node")
    leaf = walk.groupBy("key").agg(F.max_by("node", "depth").alias("node"))
    one = cut(leaf.groupBy("node").agg(F.min("key").alias("key")).select("key"))
    mine = cut(walk.join(one, "key", "left_semi").select("key", "depth", "node"))
    paths = mine.join(turning, "node").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    ranked = cut(paths.repartitionByRange("path").sortWithinPartitions("path").select(
        "key", F.col("path")[0]["node"].alias("root"), F.monotonically_increasing_id().alias("run")))

    # a node belongs to the first run that reaches it
    reached = mine.join(ranked, "key").groupBy("node").agg(F.min("run").alias("run"), F.first("root").alias("root"))
    trees = ranked.groupBy("root").agg(F.min("run").alias("tree"))
    placed = nodes.select("node", "depth", "content").join(reached, "node").join(trees, "root").join(contents.select("content", "n_tokens"), "content")
    placed = with_running_sum(placed.select("tree", "run", "depth", "node", "content", "n_tokens"), ["tree"], [F.col("run"), F.col("depth")], "n_tokens", "stop")
    placed = cut(placed.withColumn("start", F.col("stop") - F.col("n_tokens")))

    spans = placed.groupBy("run").agg(F.first("tree").alias("tree"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    seen = mine.join(ranked.select("key", F.col("run").alias("of")), "key").join(placed.select("node", "run", "stop"), "node").where("run < of")
    seen = seen.groupBy("of", "run").agg(F.max("stop").alias("upto")).join(spans.select("run", F.col("start").alias("begin")), "run")
    ancestors = seen.groupBy(F.col("of").alias("run")).agg(F.sort_array(F.collect_list(F.struct(F.col("begin").alias("start"), F.col("upto").alias("stop")))).alias("all"))
    length = F.aggregate("all", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    runs = spans.join(ancestors, "run", "left").withColumn("all", F.coalesce("all", F.filter(F.array(F.struct("start", "stop")), lambda _: F.lit(False))))
    runs = cut(runs.select("tree", "run", "start", "stop", length.alias("position"), _joined(F.col("all")).alias("ancestors")))

    position = runs.select("run", (F.col("position") - F.col("start")).alias("shift"))
    stream = placed.join(position, "run").join(contents.drop("n_tokens"), "content").select(
        "tree", "run", "depth", "start", (F.col("start") + F.col("shift")).alias("position"), "n_tokens", "ids", "loss_start", "loss_stop")
    turns = cut(walk.select("conv_id", "key", "depth", "node").join(placed.select("node", "tree", "start"), "node").drop("node"))
    return Trees(cut(stream.orderBy("tree", "start"), "zstd"), runs, turns)


def _read(shared, kind: pa.DataType):
    """Rows in the order of key and depth: a row per conversation, kept only as running digests."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets = vocabulary(shared.value)
        top = len(offsets) - 1
        marks = np.frombuffer((START + END).encode(), np.uint8)
        flat, offsets = np.concatenate([flat, marks]), np.concatenate([offsets, offsets[-1] + np.array([len(START), len(START) + len(END)])])
        size = np.diff(offsets)
        key, state = None, None
        for batch in pieces(batches, "ids"):
            done = []
            rows = batch.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
            ends = np.cumsum(size[ids])
            data = flat[np.arange(ends[-1]) + np.repeat(offsets[ids] - (ends - size[ids]), size[ids])].tobytes()
            at = np.concatenate(([0], ends))
            first = np.cumsum([0] + [len(r) // 4 for r in rows])
            for i, (name, conv, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "loss_start", "loss_stop")))):
                if name != key or state is None:
                    if state is not None:
                        done.append(_closed(*state))
                    key, state = name, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                a, b = first[i], first[i + 1]
                if ids[a] != top or np.count_nonzero(ids[a:b] >= top) != 2:
                    raise ValueError(f"no whole turn at conversation {conv!r}")
                piece = data[at[a] : at[b]].decode("utf-8", "surrogatepass")
                role, body = piece[len(START) : -len(END) - 1].split("\n", 1)
                loss = unescape(data[at[a + low] : at[a + high]].decode("utf-8", "surrogatepass"))
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if done:
                yield _digests(done, kind)
        if state is not None:
            yield _digests([_closed(*state)], kind)

    return scan


def _closed(conv, n, turns, chars, loss, formatted) -> tuple:
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_READ)


def read_back(trees: Trees, path: str) -> DataFrame:
    """Every conversation as the trees hold it: conv_id, n_turns, turns_sha256 (role, line break, text, line break a turn), loss_chars and
    loss_sha256 (texts under the loss mask), formatted_chars. Turns come one by one, so a long conversation takes no memory."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = trees.nodes.sparkSession
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = trees.turns.join(trees.nodes.select("tree", "start", "ids", "loss_start", "loss_stop"), ["tree", "start"])
    sorted_ = rows.select("key", "conv_id", "depth", "ids", "loss_start", "loss_stop").repartition("key").sortWithinPartitions("key", "depth")
    kind = trees.turns.schema["conv_id"].dataType
    return sorted_.mapInArrow(
        _read(shared, to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
