"""The trie of conversation prefixes, as the Cartesian tree over the common prefixes of sorted conversations.

Conversations become strings of 16-byte digests, one per turn. Distinct strings are sorted into blocks, and the
turns that each shares with the one before are an array L. A stretch of L between its nearest smaller values on
either side is a node of the trie: all strings in it share that many turns. Each block finds the nearest smaller
values within itself by a stack; an entry that has none there is a running minimum from the left or from the
right, and only these minima, with the sums of what lies between them, go on to be merged with the minima of
other blocks, 16 blocks at a time, until one block is left. Entries of equal L in one stretch are one node.

Between a node and its parent in that tree lie the depths at which nothing branches; these are filled in last.
Counts are sums over stretches: every stretch carries its conversations, its leaves and the tokens it saves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import if_small, materialize

#: Bytes of a turn's digest, and turns that a conversation may take from the first of its hundred.
TURN, HEAD = 16, 5
#: Strings and bytes that a block should hold, and blocks at most; larger inputs get larger blocks.
BLOCK_ROWS, BLOCK_BYTES, MAX_BLOCKS = 1024, 8 << 20, 1 << 16
#: Blocks whose minima one task merges.
MERGED = 16
#: Ids that are written as one text before they are hashed: runs of ids by their upper bits.
ID_BITS = 12

_NONE = (1 << 63) - 1
_SEQUENCES = pa.schema([("conv", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("totals", pa.list_(pa.int64())), ("sha", pa.string())])
_SORTED = pa.schema([("block", pa.int32()), ("pos", pa.int64()), ("shared", pa.int32()), *_SEQUENCES, ("last", pa.binary())])
_SUMS = [(f"{part}_{x}", pa.int64()) for part in ("head", "tail") for x in ("n", "conv", "leaves", "saved")]
_FRAME = [("shared", pa.int64()), ("total", pa.int64()), ("entries", pa.int64()), *_SUMS, ("first_len", pa.int64()), ("first_sha", pa.string())]
_NODE = [("conv", pa.int64()), ("depth", pa.int64()), ("above", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]
_FOLDED = pa.schema([("node", pa.bool_()), ("block", pa.int32()), ("pos", pa.int64()), *_FRAME, *_NODE])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def rebuild(conversations: DataFrame) -> DataFrame:
    """``conv_id`` with the ``key`` and the ``sizes`` of its turns: the first h turns of the conversation whose number ends
    in two zeros, then its own after its first h; h is the CRC-32 of the id modulo 6.

    Turns are in order of ``turn``, null first, and those of equal number in order of their digests. A null role or
    text is empty; rows without an id belong to no conversation. A conversation is one row, of 48 bytes a turn while it
    is put together and 24 afterwards; texts don't move.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turn = F.struct(F.col("turn").alias("turn"), token.alias("token"), F.length(text).cast("long").alias("size"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = materialize(own, "turns").withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    whole = F.concat(F.slice(F.coalesce("head", F.array().cast("array<struct<turn:long,token:string,size:long>>")), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    joined = own.join(heads, "base", "left").select("conv_id", whole.alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), ""))
    return joined.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one string follow each other, in order of their ids: one row with their number and the hash of the ids."""
    now, state, row = None, None, None
    for batch in batches:
        out = []
        for same, key, sizes, n, least, ids in zip(*(batch[c].to_pylist() for c in ("same", "key", "sizes", "n", "least", "ids")), strict=True):
            if same != now:
                if row is not None:
                    out.append((*row, state.hexdigest()))
                now, state, row = same, hashlib.sha256(ids.encode()), [least, n, key, [0, *np.cumsum(sizes, dtype=np.int64).tolist()]]
            else:
                state.update(b"," + ids.encode())
                row[1] += n
        yield _batch(out, _SEQUENCES)
    if row is not None:
        yield _batch([(*row, state.hexdigest())], _SEQUENCES)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sequences(rebuilt: DataFrame) -> DataFrame:
    """One row per distinct string: its smallest conversation, their number, and the hash of all their ids.

    Copies are brought together by runs of ids first, so that a string that very many conversations share is a
    few long rows; its ids pass through one task as a stream, since SHA-256 takes them in order.
    """
    runs = rebuilt.withColumn("same", F.sha2("key", 256)).groupBy("same", F.shiftright("conv_id", ID_BITS).alias("run"))
    runs = runs.agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return materialize(runs.repartition("same").sortWithinPartitions("same", "run").mapInArrow(_sequences, _ddl(_SEQUENCES)), "sequences")


def common(a: bytes, b: bytes) -> int:
    """Turns that two strings share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    differ = np.frombuffer(a, np.uint64, n // 8) != np.frombuffer(b, np.uint64, n // 8)
    return int(differ.argmax()) * 8 // TURN


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings with the turns shared with the one before; a last row, at -1, holds the first and the last string."""
    block, at, first, before = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        out = []
        for conv, n, key, totals, sha in zip(*(batch[c].to_pylist() for c in _SEQUENCES.names), strict=True):
            out.append((block, at, -1 if before is None else common(before, key), conv, n, None, totals, sha, None))
            first, before, at = key if first is None else first, key, at + 1
        yield _batch(out, _SORTED)
    if at:
        yield _batch([(block, -1, None, None, None, first, None, None, before)], _SORTED)


def fold(frames: list[list], last: bool) -> tuple[list[tuple], list[list]]:
    """Nodes whose nearest smaller values are both among ``frames``, and the frames that are left: running minima.

    A frame is an entry of L with the total size of the shared turns, the number of equal entries merged into it,
    sums over what lies before the last of these (head) and from it on (tail), and the length and hash of the string
    at that last one. ``last`` says that nothing follows.
    """
    nodes, left, stack = [], [], []
    for x in frames + ([[-1, 0]] if last else []):
        v = x[0]
        while stack and stack[-1][0] > v:
            top = stack.pop()
            if not stack:
                left.append(top)
                break
            below = stack[-1]
            above, before = (below[0], below[1]) if below[0] >= v else (v, x[1])
            n, leaves = below[7] + top[3] + top[7], below[9] + top[5] + top[9]
            conv = min(below[8], top[4], top[8])
            saved = below[10] + top[6] + top[10] + (n - 1) * (top[1] - before)
            ends = below[12] if below[11] == top[0] else None
            nodes.append((conv, top[0], above, n, top[2] + 1 - (ends is not None), leaves, saved, ends))
            below[7:11] = n, conv, leaves, saved
        if len(x) == 2:
            break
        if stack and stack[-1][0] == v:
            top = stack[-1]
            top[2] += x[2]
            top[3:7] = top[3] + top[7] + x[3], min(top[4], top[8], x[4]), top[5] + top[9] + x[5], top[6] + top[10] + x[6]
            top[7:] = x[7:]
        else:
            stack.append(list(x))
    return nodes, left + stack


def _folded(block: int, nodes: list[tuple], frames: list[list]) -> pa.Table:
    rows = [(True, None, None, *[None] * len(_FRAME), *n) for n in nodes] + [(False, block, k, *f, *[None] * len(_NODE)) for k, f in enumerate(frames)]
    return pa.Table.from_batches([_batch(rows, _FOLDED)])


def _first_level(table: pa.Table) -> pa.Table:
    """Leaves of a block of strings, and its nodes and minima."""
    table = table.sort_by("pos")
    shared, convs, counts, totals, shas = (table[c].to_pylist() for c in ("shared", "conv", "n", "totals", "sha"))
    shared[0] = table["start"][0].as_py()
    after = [*shared[1:], table["stop"][0].as_py()]
    frames, leaves = [], []
    for v, w, conv, n, t, sha in zip(shared, after, convs, counts, totals, shas, strict=True):
        length, above, saved, leaf = len(t) - 1, max(v, w), 0, 0
        if length > w:
            leaf, saved = 1, (n - 1) * (t[length] - t[max(above, 0)])
            leaves.append((conv, length, above, n, 0, 1, saved, sha))
        frames.append([v, t[max(v, 0)], 1, 0, _NONE, 0, 0, n, conv, leaf, saved, length, sha])
    nodes, frames = fold(frames, False)
    return _folded(table["block"][0].as_py(), leaves + nodes, frames)


def _next_level(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("pos", "ascending")])
        frames = [list(r) for r in zip(*(table[name].to_pylist() for name, _ in _FRAME), strict=True)]
        return _folded(table["group"][0].as_py(), *fold(frames, last))

    return run


def tree(found: DataFrame, *, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, merged: int = MERGED) -> DataFrame:
    """Nodes that branch or end, of the strings in ``found``: the smallest conversation, the depth, that of the parent
    (-1 for none), conversations, children, leaves, saved tokens from below the parent on, and the hash of the ids that end there."""
    rows, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    blocks = int(min(MAX_BLOCKS, max(1, -(-rows // block_rows), -(-size // block_bytes))))
    ordered = materialize(found.repartitionByRange(blocks, "key").sortWithinPartitions("key").mapInArrow(_shared, _ddl(_SORTED)), "sorted")
    # One row per block, of which there are at most MAX_BLOCKS.
    edges = ordered.where("pos < 0").select("block", "key", F.lag("last").over(Window.orderBy("block")).alias("before"))
    border = F.arrow_udf(lambda a, b: pa.array([-1 if x is None else common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32()), "int")
    starts = materialize(edges.select("block", border("before", "key").alias("start")), "starts")
    starts = starts.select("block", "start", F.coalesce(F.lead("start").over(Window.orderBy("block")), F.lit(-1)).alias("stop"))
    within = ordered.where("pos >= 0").drop("key", "last").join(F.broadcast(starts), "block")
    folded = materialize(within.groupBy("block").applyInArrow(_first_level, _ddl(_FOLDED)), "folded")
    nodes, groups = folded.where("node"), (ordered.agg(F.max("block")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // merged)
        minima = folded.where("not node").withColumn("group", F.floor(F.col("block") / merged).cast("int"))
        folded = materialize(minima.groupBy("group").applyInArrow(_next_level(groups == 1), _ddl(_FOLDED)), "folded")
        nodes = nodes.union(folded.where("node"))
        if groups == 1:
            return nodes.select(*[name for name, _ in _NODE])


def build(conversations: DataFrame, **options) -> DataFrame:
    """Every node of the trie of rebuilt conversations; see :func:`rebuild` for what these are.

    A node is told by ``conv_id``, the smallest conversation that starts with it, and ``depth``. A table without
    conversations has no nodes, not even a root; conversations without turns are members of the root. Repeated
    rows are repeated turns. Other columns don't matter.
    """
    found = sequences(rebuild(conversations))
    nodes = tree(found, **options)
    prefix = lambda depth: F.sha2(F.substring("key", F.lit(1), (depth * TURN).cast("int")), 256)
    total = lambda d: F.element_at("totals", F.greatest(d, F.lit(0)).cast("int") + 1)
    chain = F.transform(F.sequence(F.col("above") + 1, F.col("depth")), lambda d: F.struct(d.alias("depth"), (F.col("saved") - (F.col("n") - 1) * (total(d - 1) - total(F.col("above")))).alias("saved")))
    placed = nodes.join(found.select("conv", "key", "totals"), "conv").select("conv", "depth", "above", "n", "children", "leaves", "ends", chain.alias("chain"), prefix(F.col("depth")).alias("own"), prefix(F.col("above")).alias("up"))
    placed = materialize(placed, "nodes")
    parents = materialize(placed.where("children > 0").select(F.col("own").alias("up"), F.col("conv").alias("parent")), "parents")
    # A parent of very many nodes is one row here, and the join can split its nodes.
    joined = placed.join(if_small(parents, parents.count()), "up", "left")
    each = joined.select("conv", "depth", "above", "n", "children", "leaves", "ends", "parent", F.explode("chain").alias("at"))
    at, bottom = F.col("at.depth"), F.col("at.depth") == F.col("depth")
    return each.select(
        F.col("conv").alias("conv_id"), at.alias("depth"), F.when(at == 0, F.lit(None)).when(at > F.col("above") + 1, F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("at.saved").alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
