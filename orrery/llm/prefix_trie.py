"""Trie of conversation prefixes from sorted rows: sparse tables over the shared depths of neighbours, and binary searches.

Conversations are sorted by their turns, so the members of a prefix stand side by side. With ``shared[i]`` the number of first turns
that row i shares with row i - 1, the members of the prefix of row i and depth d reach left and right as far as no
``shared`` below d lies between. Each candidate (row, depth) finds both ends for itself, by binary search over range
minima in a sparse table; no candidate waits for another and nothing is kept open while rows pass. A candidate whose left end is
its own row is a node.

Rows are sorted by range over the cluster and cut into blocks of at most ``block_turns`` turns (or one conversation). One sparse table
lies over the rows of a block, one over the blocks: a node that crosses the end of a block is found as a piece in each block, and
the pieces, known by the block that they begin in and their depth, are added up. The table over blocks has two integers a block (one block for
half a million turns) and is all that reaches the driver.

A turn is known by 128 bits of the SHA-256 of its role and text; a conversation is one row of 16 bytes for each turn.
``ends_sha256`` hashes the ids of the conversations that end at a node: blocks join their ids to strings in parallel, and the strings
of a node are streamed through the hash in order, never held together.

Defined results: null role and text are empty; rows without a conversation id belong to no conversation; turns with equal numbers
(null is the first) are in the order of their digests; repeated rows are turns of their own; conversations without turns
are members of the root; an empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_TURNS = 500_000
#: Conversations that a range of the sort holds on average, at most.
RANGE_ROWS = 100_000
WIDTH = 16

NODE = "depth int, origin long, first_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PIECE = f"{NODE}, block long, begins boolean, crosses boolean, inside boolean, parent_origin long, parent_conv long, ends binary, ends_sha256 string"


def sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its ordered turns as (digest in hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length tells where it ends
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * WIDTH).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def share_heads(convs: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % family, h being crc32(c) % heads, and goes on with its own after its first h."""
    mine = convs.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    donors = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, heads - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    both = mine.join(donors, "donor", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, np.uint64, 2 * n).reshape(n, 2) for s in (a, b))
    return int((x != y).any(axis=1).argmax())


def _neighbours(block_turns: int):
    """A function over the batches of one sorted range: rows with what each shares with the one before, cut into blocks.

    The range's first and last keys go along once: ``kind`` is 0 for a row, 1 for the first row of the range (its key goes along) and 2 for
    a mark that holds the last key.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("conv_id", pa.int64()), ("shared", pa.int32()), ("sizes", pa.list_(pa.int64())), ("key", pa.binary())])
        before, row, held, sub = None, 0, 0, 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            out = {"kind": [], "block": [], "shared": [], "key": []}
            for key in keys:
                size = len(key) // WIDTH + 1
                if held and held + size > block_turns:
                    sub, held = sub + 1, 0
                held += size
                out["kind"].append(1 if before is None else 0)
                out["key"].append(key if before is None else None)
                out["shared"].append(0 if before is None else _common(before, key))
                out["block"].append((part << 32) + sub)
                before = key
            n = len(keys)
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(out["block"], pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array(out["kind"], pa.int32()), batch.column("conv_id"), pa.array(out["shared"], pa.int32()), batch.column("sizes").cast(pa.list_(pa.int64())), pa.array(out["key"], pa.binary())], schema=schema)
            row += n
        if before is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((part, (part << 32) + sub, row, 2, None, None, None, before), schema.types, strict=True)], schema=schema)

    return cut


def sorted_blocks(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(range, block, row, kind, conv_id, shared, sizes, key), written: conversations in order, as ``_neighbours`` describes them."""
    spark = convs.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = materialize(convs.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")), "sequences")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ordered = rows.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return materialize(ordered.mapInArrow(_neighbours(block_turns), "range int, block long, row long, kind int, conv_id long, shared int, sizes array<long>, key binary"), "sorted")


def _range_starts(blocks: DataFrame) -> dict[int, int]:
    """For each range with rows, the depth that its first row shares with the last row of the range before: one entry a range."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = b.column("key").to_pylist(), b.column("last").to_pylist()
            yield pa.record_batch([b.column("range"), pa.array([0 if y is None else _common(y, x) for x, y in zip(first, last, strict=True)], pa.int32())], names=["range", "shared"])

    ends = blocks.where("kind > 0").select("range", "kind", "key")
    # the window holds two rows a range
    order = Window.orderBy("range", "kind")
    met = ends.withColumn("last", F.lag("key").over(order)).where("kind = 1").select("range", "key", "last")
    return {r["range"]: r["shared"] for r in met.mapInArrow(compare, "range int, shared int").toLocalIterator()}


class RangeMinima:
    """Sparse table: minima of all stretches of 1, 2, 4, ... entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            low, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last position up to which all entries after ``at`` are ``depth`` or more."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            can = at + 2**k < n
            can[can] = self.levels[k][at[can] + 1] >= depth[can]
            at[can] += 2**k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first position from which all entries up to ``at``, itself among them, but not its own are ``depth`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = at - 2**k >= 0
            can[can] = self.levels[k][at[can] - 2**k + 1] >= depth[can]
            at[can] -= 2**k
        return at

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][left[at]], self.levels[level][right[at] - 2**level + 1])
        return out


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _block_pieces(conv: np.ndarray, shared: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: int, after: int, over: RangeMinima) -> dict[str, list | np.ndarray]:
    """Pieces of nodes in one block. ``sizes[starts[i]:starts[i + 1]]`` are the bytes of row i's turns; ``place`` is the block's place
    among the blocks, ``after`` what the first row of the next one shares with this one's last (-1: there is none).

    ``inside``: the parent lies in this block as a whole, and ``parent_conv`` is its least member; else ``parent_origin`` names it.
    """
    m, lens = len(conv), np.diff(starts)
    inner = shared.copy()
    inner[0] = 0
    table, ids = RangeMinima(inner), RangeMinima(conv)
    # every prefix of every row is a candidate
    row = np.repeat(np.arange(m), lens)
    depth = np.arange(len(sizes)) - starts[row] + 1
    left = table.left(row, depth)
    node = np.flatnonzero(left == row)
    i, d = row[node], depth[node]
    right = table.right(i, d)
    goes_on = (i == 0) & (d <= shared[0])  # began in an earlier block
    leaves = (right == m - 1) & (after >= d)
    crosses = goes_on | leaves
    origin = np.where(crosses, place, -1)
    origin[goes_on] = over.left(np.full(goes_on.sum(), place - 1), d[goes_on])
    # the piece of the parent: the prefix one shorter, from its own left end
    number = np.full(len(sizes) + 1, -1)
    number[node] = np.arange(len(node))
    deeper = d > 1
    up = node - 1
    parent = np.full(len(node), -1)
    parent[deeper] = number[starts[left[up[deeper]]] + d[deeper] - 2]
    begins = ~goes_on
    children = np.bincount(parent[begins & deeper], minlength=len(node))
    # a row ends a leaf if the next one is neither its copy nor its extension
    following = np.append(shared[1:], after)
    leaf = _running((following < lens).astype(np.int64))
    total = _running(sizes)
    upto = total[starts[:-1] + shared] - total[starts[:-1]]  # bytes that a row shares with the one before
    kept = _running(upto)
    counted = i + begins  # the row that a node begins with shares nothing of it
    above = total[starts[i] + d - 1] - total[starts[i]]
    saved = kept[right + 1] - kept[counted] - (right + 1 - counted) * above
    # conversations that end here come first, in the order of their ids
    same = np.zeros(m + 1, np.int64)
    for at in range(m - 1, 0, -1):
        same[at - 1] = same[at] + 1 if shared[at] == lens[at] == lens[at - 1] else 0
    ends = [",".join(map(str, conv[a : a + same[a] + 1].tolist())).encode() if n == depth_ else None for a, n, depth_ in zip(i.tolist(), lens[i].tolist(), d.tolist(), strict=True)]
    least = ids.least(i, right)
    out = {
        "depth": d, "origin": origin, "first_conv": least, "n_convs": right - i + 1, "n_children": children, "n_leaves": leaf[right + 1] - leaf[i], "saved_tokens": saved,
        "begins": begins, "crosses": crosses, "parent_origin": np.where(deeper, origin[parent], -1), "inside": deeper & ~crosses[parent], "parent_conv": least[parent], "ends": ends,
    }
    none = int(np.searchsorted(lens > 0, True))  # conversations without turns stand first
    root = {
        "depth": 0, "origin": -1, "first_conv": conv.min(), "n_convs": m, "n_children": int((begins & ~deeper).sum()), "n_leaves": leaf[-1], "saved_tokens": kept[-1],
        "begins": place == 0, "crosses": True, "parent_origin": -1, "inside": False, "parent_conv": -1, "ends": ",".join(map(str, conv[:none].tolist())).encode() if none else None,
    }
    return {k: [*v, root[k]] if k == "ends" else np.append(v, root[k]) for k, v in out.items()}


EMPTY = hashlib.sha256(b"").hexdigest()


def pieces(blocks: DataFrame) -> DataFrame:
    """Nodes that lie in one block, whole, and the pieces of the others."""
    starts = _range_starts(blocks)
    least = blocks.where("kind < 2").groupBy("block").agg(F.min(F.when(F.col("kind") == 0, F.col("shared"))).alias("least"), F.min_by("shared", "row").alias("first"), F.max("kind").alias("opens"), F.first("range").alias("range"))
    per_block = sorted((r["block"], r["least"], starts[r["range"]] if r["opens"] else r["first"]) for r in least.toLocalIterator())
    names = np.array([b for b, _, _ in per_block], np.int64)
    first = np.array([f for _, _, f in per_block], np.int32)
    least_of = np.array([f if x is None else min(x, f) for _, x, f in per_block], np.int32)

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        place = int(np.searchsorted(names, rows["block"][0].as_py()))
        lists = rows["sizes"].chunk(0) if rows["sizes"].num_chunks else pa.array([], pa.list_(pa.int64()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        sizes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        shared = rows["shared"].to_numpy().astype(np.int64).copy()
        shared[0] = first[place]
        after = int(first[place + 1]) if place + 1 < len(first) else -1
        out = _block_pieces(rows["conv_id"].to_numpy(), shared, offsets - offsets[0], sizes, place, after, RangeMinima(least_of))
        n = len(out["depth"])
        crosses = out["crosses"]
        ends = out.pop("ends")
        digest = [None if c else hashlib.sha256(e).hexdigest() if e else EMPTY for c, e in zip(crosses.tolist(), ends, strict=True)]
        columns = {
            **{k: pa.array(v, pa.int32() if k == "depth" else pa.bool_() if k in ("begins", "crosses", "inside") else pa.int64()) for k, v in out.items()},
            "block": pa.array(np.full(n, place), pa.int64()), "ends": pa.array([e if c else None for c, e in zip(crosses.tolist(), ends, strict=True)], pa.binary()), "ends_sha256": pa.array(digest, pa.string()),
        }
        return pa.table({k.strip().split()[0]: columns[k.strip().split()[0]] for k in PIECE.split(",")})

    return blocks.where("kind < 2").select("block", "row", "conv_id", "shared", "sizes").groupBy("block").applyInArrow(of_block, PIECE)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined strings of each node; its rows come one after the other, in order of their blocks."""
    node, state = None, None

    def row(node, state):
        return pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int32()), pa.array([state.hexdigest()])], names=["origin", "depth", "sha"])

    for b in batches:
        for origin, depth, text in zip(*(b.column(c).to_pylist() for c in ("origin", "depth", "ends")), strict=True):
            if (origin, depth) != node:
                if node is not None:
                    yield row(node, state)
                node, state = (origin, depth), hashlib.sha256(text)
            else:
                state.update(b"," + text)
    if node is not None:
        yield row(node, state)


def trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = materialize(pieces(sorted_blocks(convs, block_turns)), "pieces")
    cross = found.where("crosses")
    sums = cross.groupBy("origin", "depth").agg(
        F.min("first_conv").alias("first_conv"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max(F.when(F.col("begins"), F.col("parent_origin"))).alias("parent_origin")
    )
    strings = cross.where("ends IS NOT NULL").select("origin", "depth", "block", "ends")
    hashes = strings.repartition("origin", "depth").sortWithinPartitions("origin", "depth", "block").mapInArrow(_hashes, "origin long, depth int, sha string")
    whole = sums.join(hashes, ["origin", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")
    whole = materialize(whole.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))), "crossing")
    columns = ["depth", "first_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # a block's nodes meet its own pieces of their parents: no key has more rows than a block
    reached = cross.select("block", "origin", "depth").join(whole.select("origin", "depth", F.col("first_conv").alias("up")), ["origin", "depth"]).select("block", F.col("origin").alias("parent_origin"), (F.col("depth") + 1).alias("depth"), "up")
    local = found.where("NOT crosses")
    inside = local.where("inside").select(*columns, F.col("parent_conv").alias("up"))
    below = local.where("NOT inside").join(reached, ["block", "parent_origin", "depth"]).select(*columns, "up")
    parents = whole.select(F.col("origin").alias("parent_origin"), (F.col("depth") + 1).alias("depth"), F.col("first_conv").alias("up"))
    crossing = whole.join(parents, ["parent_origin", "depth"], "left").select(*columns, "up")
    everything = inside.unionByName(below).unionByName(crossing)
    long = {"conv_id": "first_conv", "depth": "depth", "parent_conv_id": "up", "n_convs": "n_convs", "n_children": "n_children", "n_leaves": "n_leaves", "saved_tokens": "saved_tokens"}
    return everything.select(*[F.col(c).cast("long").alias(k) for k, c in long.items()], "ends_sha256")
