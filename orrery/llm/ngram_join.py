"""Similarity join of word-shingle sets at a Jaccard threshold, by token-combination prefixes.

1. Every text gives its set of shingle hashes, a digest of the set (texts with equal sets are one *class* from here on), and
   counts of shingles by hash bucket. Counts cover every shingle of every text. They sort buckets into three token classes:
   unique (below ``rare_from``, 2 unless the bitmap would overfill), rare, and frequent (``FREQUENT`` or more).
   Classes travel as two bitmaps of fixed size. A bucket that two shingles share can only raise a class, the same way for
   all texts, which costs time and never a link.
2. Shingles are ordered by class, then hash. Two sets that link at t share all but (1 - t) n of either's n shingles, so a prefix
   with one more shingle than that holds a shared one. Unique ones count in the prefix and are not indexed. Rare ones are
   indexed alone. Frequent ones are indexed in pairs, within hash groups whose number depends on the size band: a prefix is
   extended until the sum over its groups of (members - 1) makes up the need, which guarantees a shared pair.
   Each set is indexed under its band and the next, so that neighbouring sizes meet.
3. Index lists of up to ``SHORT_LIST`` classes give all their pairs. In a longer list every class is paired with the list's
   pivot (the class with most copies). All pairs are verified on whole sets and the links give components.
4. Two members of a long list that are both in the pivot's component need no comparison. All others, the *outsiders*, are
   compared with every member under the same pivot, in blocks of bounded size, and links that join components are added.
   So no list is expanded into all its pairs, and no component misses a link.

Components are found by star contraction in Spark; nothing about texts, links or components goes to the driver.

Defined results: texts without words have empty sets and link with nothing; a text with fewer words than a shingle is one
shingle; a null id never is a component's id unless all of its rows have null ids; rows repeated count once as a
class and come back as often as they come; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, materialize_by, rows_of

BATCH_BYTES = 2 << 20
#: Shingles of a task that are counted together before they are sent.
FLUSH = 2_000_000
RANGE_BITS = 8
#: Bits of the bitmap of rare and frequent shingles: the first that suffices, at most 32 MB; and of that of frequent ones.
RARE_BITS, FREQUENT_BITS = [22, 24, 26, 27, 28], 24
#: Shares of the bitmaps that may be set; the class bounds rise until it holds.
FILL = 1 / 12
#: Most bits of the bitmap of classes whose sets are wanted.
WANTED_BITS = 28
FREQUENT = 24
SHORT_LIST = 4
BLOCK = 2048

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BATCH_BYTES + (1 << 16))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    lengths = np.array([len(t) + 1 for t in texts])
    b = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * up[: len(b)])]
    words = mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    ends = np.cumsum(lengths)
    per = np.searchsorted(first, ends)
    out, at = [], 0
    n = max(0, len(words) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + mix(words[k : k + n] + np.uint64(k + 1))
    grams = mix(grams)
    for to in per:
        if to == at:
            out.append(grams[:0])
        elif to - at < size:
            short = np.array([to - at], np.uint64)
            for k in range(at, to):
                short = mix(short + words[k : k + 1])
            out.append(short)
        else:
            out.append(np.unique(grams[at : to - size + 1]))
        at = to
    return out


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def class_key(s: np.ndarray) -> int:
    """63 bits of the set's digest: the class's number."""
    return int.from_bytes(digest_of(s)[:8], "little") >> 1


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending bucket numbers as byte planes of their steps, and counts, compressed."""
    steps = np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(steps + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, n)
    steps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
    return np.cumsum(steps, dtype=np.int64), counts.astype(np.int64)


def read_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in rows_of(batches, BATCH_BYTES, "text"):
        yield batch.column("id").to_pylist() if "id" in batch.schema.names else [], shingle_sets([t or b"" for t in batch.column("text").to_pylist()], size)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Rows of texts (id, n, key) and rows of counts (part, n, blob)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_arrow, waiting, held = None, [], 0

        def counts() -> pa.RecordBatch:
            buckets, n = np.unique(np.concatenate(waiting), return_counts=True)
            span = 32 - RANGE_BITS
            cuts = np.searchsorted(buckets, np.arange((1 << RANGE_BITS) + 1, dtype=np.int64) << span)
            rows = [(part, b - a, packed(buckets[a:b].astype(np.int64) - (part << span), n[a:b])) for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            part, many, blob = zip(*rows, strict=True)
            none = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(none, id_arrow), pa.array(many, pa.int64()), pa.nulls(none, pa.int64()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["id", "n", "key", "part", "blob"])

        for batch in rows_of(batches, BATCH_BYTES, "text"):
            id_arrow = batch.schema.field("id").type
            sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], size)
            waiting += [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
            held += sum(map(len, sets))
            m = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["id", "n", "key", "part", "blob"])
            if held > FLUSH:
                yield counts()
                waiting, held = [], 0
        if held:
            yield counts()

    return docs.mapInArrow(run, f"id {id_type}, n long, key long, part int, blob binary")


LEVELS = [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 1 << 14, 1 << 16, 1 << 18, 1 << 20, 1 << 24, 1 << 28, 1 << 31]


def bucket_counts(group: pa.Table) -> pa.Table:
    """All counts of one range of buckets: those of two or more, and how many reach each level."""
    parts = [unpacked(b, n) for b, n in zip(group.column("blob").to_pylist(), group.column("n").to_pylist(), strict=True)]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
    keys, counts = keys[counts > 1], np.minimum(counts[counts > 1], (1 << 32) - 1)
    reach = [int((counts >= x).sum()) for x in LEVELS]
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "blob": pa.array([packed(keys, counts)], pa.binary()), "reach": pa.array([reach], pa.list_(pa.int64()))})


class Bitmap:
    """Membership of hashes by their top bits."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = np.uint64(64 - bits), data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.bits
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def class_bitmaps(counts: DataFrame) -> tuple[int, Bitmap, Bitmap]:
    """The count from which a shingle is rare rather than unique, and the bitmaps of rare or frequent and of frequent ones."""
    reach = np.zeros(len(LEVELS), np.int64)
    for r in counts.select("reach").collect():  # 2**RANGE_BITS rows
        reach += r["reach"]
    rare_bits = next((b for b in RARE_BITS if reach[0] <= FILL * (1 << b)), RARE_BITS[-1])
    low = next(x for x, n in zip(LEVELS, reach, strict=True) if n <= FILL * (1 << rare_bits))
    high = next(x for x, n in zip(LEVELS, reach, strict=True) if x >= max(FREQUENT, low) and n <= FILL * (1 << FREQUENT_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "blob")), strict=True):
                keys, counts = unpacked(blob, n)
                made = []
                for bits, least in ((rare_bits, low), (FREQUENT_BITS, high)):
                    mark = np.zeros(1 << (bits - RANGE_BITS), np.uint8)
                    mark[keys[counts >= least] >> (32 - bits)] = 1
                    made.append(np.packbits(mark, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made[0]]), pa.array([made[1]])], ["part", "rare", "frequent"])

    data = [np.zeros(1 << (bits - 3), np.uint8) for bits in (rare_bits, FREQUENT_BITS)]
    for r in counts.select("part", "n", "blob").mapInArrow(run, "part int, rare binary, frequent binary").collect():  # at most 32 and 2 MB
        for d, b in zip(data, (r["rare"], r["frequent"]), strict=True):
            d[r["part"] * len(b) : (r["part"] + 1) * len(b)] = np.frombuffer(b, np.uint8)
    return low, Bitmap(rare_bits, data[0]), Bitmap(FREQUENT_BITS, data[1])


def band_width(percent: int) -> float:
    """Logarithm of a band's sizes' ratio: linked sets are in the same band or the next."""
    return float(np.log(105 / percent))


def groups_of(band: int, percent: int) -> int:
    """Hash groups of frequent shingles in a band: about five prefix shingles each."""
    return max(1, int(np.exp(band * band_width(percent)) * (100 - percent) / 500))


def signatures(s: np.ndarray, rare_from: int, rare: Bitmap, frequent: Bitmap, percent: int) -> np.ndarray:
    """What a set is indexed under."""
    n = len(s)
    need = n - -(-n * percent // 100) + 1
    known = rare.has(s)
    unique, rest = s[~known], s[known]
    out = [unique[:need]] if rare_from > 2 else []
    need -= len(unique)
    if need <= 0:
        return out[0] if out else s[:0]
    often = frequent.has(rest)
    single, rest = rest[~often], rest[often]
    out.append(single[:need])
    need -= len(single)
    if need > 0 and len(rest):
        band = int(np.log(n) / band_width(percent))
        for scheme in (band, band + 1):
            group = (mix(rest ^ np.uint64(0x5BD1E995)) % np.uint64(groups_of(scheme, percent))).astype(np.int64)
            # how far the prefix must run: each group's first member gives nothing
            seen = np.zeros(len(rest), bool)
            seen[np.unique(group, return_index=True)[1]] = True
            gain = np.cumsum(~seen)
            stop = min(int(np.searchsorted(gain, need)) + 1, len(rest))
            order = np.argsort(group[:stop], kind="stable")
            tokens, of = rest[:stop][order], group[:stop][order]
            # pairs of members of one group, by distance in the group
            step = 1
            while step < stop and (same := of[step:] == of[:-step]).any():
                a, b = tokens[:-step][same], tokens[step:][same]
                out.append(mix(mix(a + np.uint64(scheme)) * np.uint64(0x9E3779B97F4A7C15) + b))
                step += 1
    return np.unique(np.concatenate(out)) if out else s[:0]


def index(docs: DataFrame, size: int, percent: int, classes: tuple[int, Bitmap, Bitmap]) -> DataFrame:
    """(sig, key, n): one entry for each signature and class, at most once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, sets in read_sets(batches, size):
            sig, key, n = [], [], []
            for s in sets:
                if len(s) and (k := class_key(s)) not in done:
                    done.add(k)
                    x = signatures(s, *shared.value, percent)
                    sig.append(x)
                    key.append(np.full(len(x), k))
                    n.append(np.full(len(x), len(s)))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["sig", "key", "n"])

    entries = materialize(docs.select("text").mapInArrow(run, "sig long, key long, n long"), "index")
    shared.destroy()
    return entries


def wanted_sets(docs: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """(key, members) of the wanted classes. A bitmap of 16 bits a class and 32 MB at most keeps most other sets from being sent."""
    bits = min(WANTED_BITS, max(15, (16 * keys.count()).bit_length()))
    bit = F.col("key").bitwiseAND((1 << bits) - 1) + 1
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect():  # at most 32 MB
        data[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, sets in read_sets(batches, size):
            key, members = [], []
            for s in sets:
                if len(s):
                    k = class_key(s)
                    place = k & ((1 << bits) - 1)
                    if k not in done and shared.value[place >> 3] >> (place & 7) & 1:
                        done.add(k)
                        key.append(k)
                        members.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(members, pa.binary())], ["key", "members"])

    found = docs.select("text").mapInArrow(run, "key long, members binary").join(keys.hint("shuffle_hash"), "key", "left_semi")
    sets = materialize_by(found.groupBy("key").agg(F.first("members").alias("members")), "members", "key")
    shared.destroy()
    return sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the least node reachable, by large and small stars.

    Edges always point from the larger node to the smaller one. Each star is one small plan whose result is written.
    """

    def settled(edges: DataFrame) -> bool:
        """Whether every node has one edge down at most, and none that has one is the end of another."""
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))))
        nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("top"))
        return nodes.agg(F.count_if((F.col("down") > 1) | (F.col("down") == 1) & (F.col("top") == 0))).first()[0] == 0

    def large(edges: DataFrame) -> DataFrame:
        """Every larger neighbour of a node moves to the node's least neighbour."""
        both = edges.select(F.inline(F.array(F.struct(F.col("b").alias("b"), F.col("a").alias("m")), F.struct(F.col("a").alias("b"), F.col("b").alias("m")))))
        least = both.groupBy("b").agg(F.least("b", F.min("m")).alias("m"))
        return edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()

    def small(edges: DataFrame) -> DataFrame:
        """A node and its smaller neighbours move to the least of them."""
        moved = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
        return moved.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not settled(edges):
        moved = materialize(large(edges), "large")
        forget(edges)
        edges = materialize(small(moved), "small")
        forget(moved)
    roots = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), "roots")
    forget(edges)
    return roots


def outsider_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of outsiders with members of other components under the same pivot. ``members``: (pivot, key, root)."""
    home = members.where("key = pivot").select("pivot", F.col("root").alias("home"))
    known = materialize(members.join(home, "pivot").select("pivot", "key", "root", (F.col("root") != F.col("home")).alias("outside")), "known")
    sizes = known.groupBy("pivot").agg(F.count("*").alias("g"), F.count_if("outside").alias("q")).where("q > 0")
    grid = sizes.select("pivot", F.ceil(F.col("g") / BLOCK).cast("int").alias("gb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    cells = lambda n, cell: F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)
    cell = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.alias("i"), j.alias("j"))
    # every member is a row of the grid's blocks, an outsider one of its columns too
    inner, outer = cells("qb", lambda j: cell(False, place("gb"), j)), cells("gb", lambda i: cell(True, i, place("qb")))
    dealt = known.join(grid, "pivot").join(sets, "key").select("pivot", "key", "root", "members", F.inline(F.when(F.col("outside"), F.concat(inner, outer)).otherwise(inner)))

    def run(group: pa.Table) -> pa.Table:
        key, root, asks = (group.column(c).to_numpy() for c in ("key", "root", "asks"))
        sets = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
        inside = np.flatnonzero(~asks)
        n = np.array([len(sets[i]) for i in inside])
        tokens, owner = np.concatenate([sets[i] for i in inside]) if len(inside) else np.zeros(0, np.uint64), np.repeat(np.arange(len(inside)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        a, b = [], []
        for q in np.flatnonzero(asks):
            low, high = np.searchsorted(tokens, sets[q], "left"), np.searchsorted(tokens, sets[q], "right")
            width = high - low
            at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
            shared = np.bincount(owner[at], minlength=len(inside))
            hit = inside[(100 * shared >= percent * (n + len(sets[q]) - shared)) & (root[inside] != root[q])]
            for r in np.unique(root[hit]):
                a.append(key[q])
                b.append(key[hit[root[hit] == r]].min())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


def similarity_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; sets link at Jaccard similarity of ``percent`` hundredths or more."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    described = materialize(describe(docs, size), "sets")
    texts = described.where("part is null").select("id", "n", "key")
    classes = materialize(texts.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    counts = materialize(described.where("part is not null").select("part", "n", "blob").groupBy("part").applyInArrow(bucket_counts, "part int, n long, blob binary, reach array<long>"), "buckets")
    entries = index(docs, size, percent, class_bitmaps(counts))
    lists = entries.groupBy("sig").agg(F.count("*").alias("g"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("sig", "g")
    shared = materialize(entries.join(lists, "sig").distinct(), "lists")
    forget(counts, entries)
    short, long_ = shared.where(F.col("g") <= SHORT_LIST), shared.where(F.col("g") > SHORT_LIST)
    x, y = short.select("sig", F.col("key").alias("a"), F.col("n").alias("na")), short.select("sig", F.col("key").alias("b"), F.col("n").alias("nb"))
    fits = lambda p, q: F.lit(100) * F.least(p, q) >= F.lit(percent) * F.greatest(p, q)
    near = x.join(y, "sig").where((F.col("a") < F.col("b")) & fits(F.col("na"), F.col("nb"))).select("a", "b")
    pivots = long_.join(classes.select("key", "copies"), "key").groupBy("sig").agg(F.max_by(F.struct("key", "n"), F.struct("copies", "key")).alias("p")).select("sig", F.col("p.key").alias("pivot"), F.col("p.n").alias("pn"))
    under = materialize(long_.join(pivots, "sig").select("pivot", "pn", "key", "n").distinct(), "pivots")
    spokes = under.where((F.col("key") != F.col("pivot")) & fits(F.col("n"), F.col("pn"))).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
    pairs = materialize(near.union(spokes).distinct(), "pairs")
    forget(shared)
    keys = materialize(pairs.select(F.inline(F.array(F.struct(F.col("a").alias("key")), F.struct(F.col("b").alias("key"))))).union(under.select("key")).distinct(), "keys")
    sets = wanted_sets(docs, size, keys)
    roots = components(verified(pairs, sets, percent))
    forget(pairs, keys)
    rooted = under.select("pivot", "key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    more = materialize(outsider_links(rooted, sets, percent), "outsiders")
    # both ends of a late link stand for their components
    late = more.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(late)
    tops = roots.join(joined.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("top")).union(joined).groupBy("node").agg(F.min("top").alias("top"))
    # copies meet in one row of their class first, so a large class is one row here; most classes link with nothing
    linked = materialize(tops.withColumnRenamed("node", "key").join(classes.select("key", "least"), "key"), "linked")
    named = linked.join(linked.groupBy("top").agg(F.min("least").alias("component")), "top").select("key", "component")
    forget(under, sets, more)
    out = texts.hint("merge").join(classes.select("key", "least").join(named, "key", "left"), "key")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("id")).alias("component_id"))
