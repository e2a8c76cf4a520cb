"""Best-fit decreasing packing of token sequences.

Documents are encoded, closed by one separator id, and only those longer than the limit are cut; all pieces but the first
fill a sequence alone. The rest is packed by best-fit decreasing over *lengths*: pieces of equal length are alike, so the
driver holds only a histogram of at most ``limit`` lengths, and a segment tree over remaining capacities finds the tightest
open capacity that fits in logarithmic time. The outcome is a list of runs ("ranks a..b of length l go to sequences
s, s+1, ... at offset o"), at most a few per pair of length and capacity, which the tasks apply to the pieces by their
rank in their length. It is exactly the packing that best-fit decreasing gives one document at a time.

Ranks are taken in (length, hash bucket) cells of bounded size and offset by the cells before, so a length that a third of
all documents share isn't ranked in one task.

Defined results: a null text is empty and becomes one piece of one id (the separator). Repeated rows are packed each.
Rows with a null id are packed as well. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of

CACHE_PARTS = 400_000
BATCH_BYTES = 8 << 20


class CapacityTree:
    """Counts of open bins by remaining capacity, and the least capacity at or above a need that has one."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.bins: list[list[list[int]]] = [[] for _ in range(limit + 1)]

    def put(self, capacity: int, first: int, count: int) -> None:
        runs = self.bins[capacity]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += count
        else:
            runs.append([first, count])
        self._mark(capacity, True)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        run = self.bins[capacity][-1]
        count = min(most, run[1])
        run[1] -= count
        first = run[0] + run[1]
        if not run[1]:
            self.bins[capacity].pop()
            if not self.bins[capacity]:
                self._mark(capacity, False)
        return first, count

    def tightest(self, need: int) -> int | None:
        node = self.leaves + need
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves

    def _mark(self, capacity: int, on: bool) -> None:
        node = self.leaves + capacity
        self.filled[node] = on
        while node > 1:
            node >>= 1
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]


def best_fit_runs(histogram: dict[int, int], limit: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), ordered by length and rank.

    The tightest capacity takes pieces of one length until nothing more fits, as what is left of it is tighter still.
    """
    tree, opened, runs = CapacityTree(limit), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            per = (capacity or limit) // length
            need = -(-left // per)
            if capacity is None:
                capacity, first, bins, opened = limit, opened, need, opened + need
            else:
                first, bins = tree.take(capacity, need)
            placed = min(left, bins * per)
            full, rest = divmod(placed, per)
            for depth in range(per if full else rest):
                count = full + (depth < rest)
                runs.append((length, rank, count, first, limit - capacity + depth * length))
                rank += count
            if full and capacity > per * length:
                tree.put(capacity - per * length, first, full)
            if rest and capacity > rest * length:
                tree.put(capacity - rest * length, first + full, 1)
            left -= placed
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


class _Parts(dict):
    """Ids of text parts as little-endian unsigned 32-bit bytes; a part follows a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHE_PARTS:
            self.clear()
        ids = self[part] = array("I", self.encode(" " + part)).tobytes()
        return ids


def id_encoder(json_path: str, ranks_path: str | None = None):
    """A function from a text to its ids as bytes, equal to what ``tokenizers`` gives for ``json_path``.

    The byte-level pattern starts a token at every single space before a non-space, so a text without other white space
    next to a space may be cut there and its parts, which recur, kept in a dictionary. Other texts go to the library
    whole. ``ranks_path`` names the same vocabulary as merge ranks, for a faster encoder of the parts.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def library(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    encode = library
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    parts = _Parts(encode)
    # Latin, Greek and Cyrillic letters are classed alike by all Unicode tables; anything rarer goes to the library
    plain, uneven = re.compile(r"[^\x00-\u024f\u0386-\u03ce\u0400-\u045f\u2010-\u2027\u20ac]"), re.compile(r" \s|\s ")

    def ids(text: str) -> bytes:
        if uneven.search(text) or plain.search(text) or any(s in text for s in specials):
            return array("I", library(text)).tobytes()
        head, *rest = text.split(" ")
        return array("I", encode(head)).tobytes() + b"".join(map(parts.__getitem__, rest))

    return ids


PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, limit: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: (id, piece, start, length, ids_crc32)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    closing = array("I", [separator]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in rows_of(batches, BATCH_BYTES, text_col):
            encode = encode or id_encoder(json_path, ranks_path)
            out = []
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                ids = encode(text or "") + closing
                total = len(ids) // 4
                cuts = [0, *range(total % limit or limit, total, limit), total] if total > limit else [0, total]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (batch.schema.field(id_col).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {PIECES}")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with its ``sequence_id`` and ``offset``.

    Shuffles move piece rows of about 40 bytes, never texts or ids. The broadcast runs number at most a few times the
    square of ``limit`` whatever the input.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, json_path, ranks_path, limit, separator, id_col, text_col), "pieces")
    bucket_rows = 1 << 12
    total = pieces.count()
    buckets = max(1, -(-total // bucket_rows))
    cell = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    placed = pieces.withColumn("_bucket", cell)
    cells = placed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    runs = spark.sparkContext.broadcast(best_fit_runs(histogram, limit))
    within = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")
    names = [id_col, *[p.split()[0] for p in PIECES.split(", ")]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 40 | rank, "right") - 1
            hit = table[at] if len(at) else table[:0]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(place, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {PIECES}, sequence_id long, offset long")
