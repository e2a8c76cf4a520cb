"""Prediction by partial matching: code lengths of whole texts under a byte-context model of the corpus.

Model. A text is its UTF-8 bytes and one end symbol, each coded in the context of the ``ORDER`` bytes before it (texts start
behind padding symbols; padding and end are byte values that UTF-8 never uses). The trie of contexts is the table of
distinct byte (ORDER+1)-grams of the training texts with their counts: shorter contexts are sums over its suffixes.
Coding starts at the longest context seen in training. There a symbol seen n times gets (n - 1/2) / total, the escape to the
next shorter context distinct / (2 total) (escape method D). After an escape the symbols of the longer context are excluded.
Since the followers of a context are followers of its suffix too, what exclusion removes is one number per context: the
suffix's count of the context's followers. Below order 0 the symbols not seen at all share the rest equally.

Jobs. Texts are cut into pieces that end at white space and pieces are dealt by hash to blocks of about ``BLOCK_BYTES``.
A block gives its distinct grams and words with their training counts, in compressed parcels by hash range. Grams meet by the
last three bytes of their context, so that all their contexts down to order 3 are in one task; contexts alike in those bytes
have at most 257**3 grams. Orders below 3 are one table of at most 257**3 rows (some ten thousand in practice), the only data
that is broadcast. A range sends each block the log-probabilities of what it asked for, in the order of its parcel, and the
block scores its pieces by look-up (probabilities travel with 24 significant bits, sums are double). Nothing is collected from the corpus but that table and
two totals. A block's tasks are bounded by the block; a hot source or group of copies spreads over blocks as pieces are hashed by id. A
range's task holds what all blocks ask of its contexts: on average half as many grams as one block asks for in all, but for a range with
a context as common as " th" a share of all blocks' distinct grams, which grows with the input. Parcels number blocks times ranges, and so
grow with the square of the input.

Base model: words and one end per text under counts with additive smoothing, as in the query's contract.

Defined results: null texts are empty (one end symbol); rows with equal ids are scored apart only if their texts differ, equal
rows are returned as often as they come; with no training text every symbol costs log10(1/257); an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

ORDER = 5
#: Order of the table that every task holds; ranges keep together what shares the context of the next order.
LOW = 2
PAD, END = b"\xfe", b"\xff"
ALPHABET = 257
BLOCK_BYTES = 6 << 20
PIECE_BYTES = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"


def cut_pieces(text: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """(context before, piece, whether it is the last): pieces end behind white space, a longer word stays whole."""
    start = 0
    while True:
        stop = start + PIECE_BYTES
        if stop < len(text):
            while stop < len(text) and text[stop - 1] not in WHITE:
                stop += 1
        stop = min(stop, len(text))
        before = text[max(0, start - ORDER) : start]
        yield PAD * (ORDER - len(before)) + before, text[start:stop], stop == len(text)
        if stop == len(text):
            return
        start = stop


def pieces_of(docs: DataFrame, train: Column, blocks: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 8 << 20, "text"):
            row, held, last, trains = [], [], [], []
            for r, t, x in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                for before, piece, final in cut_pieces(t):
                    row.append(r)
                    held.append(before + piece)
                    last.append(final)
                    trains.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(held, pa.binary()), pa.array(last), pa.array(trains)], ["row", "piece", "last", "train"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), train.alias("train")).withColumn("row", F.xxhash64("id", "text"))
    pieces = rows.select("row", "text", "train").mapInArrow(run, "row long, piece binary, last boolean, train boolean")
    return pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int"))


class Block:
    """The pieces of one block as one byte array, with the places that are coded."""

    def __init__(self, pieces: list[bytes], last: list[bool]):
        parts = [p + END if e else p for p, e in zip(pieces, last, strict=True)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        self.sizes = ends - starts - ORDER
        coded = np.ones(len(self.bytes), bool)
        for k in range(ORDER):
            coded[starts + k] = False
        self.places = np.flatnonzero(coded)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each coded place the number of its gram, and the distinct grams in ascending order."""
        every = np.zeros(max(0, len(self.bytes) - ORDER), np.uint64)
        for i in range(0, len(every), STRETCH):  # a stretch stays in the processor's cache over all steps
            code = every[i : i + STRETCH]
            for k in range(ORDER + 1):
                code <<= np.uint64(8)
                code |= self.bytes[i + k : i + k + len(code)]
        at, grams = numbered(every[self.places - ORDER])
        return at, grams.astype(np.int64)


STRETCH = 1 << 16


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, for many repeats: only the distinct codes are sorted."""
    held = pa.array(code).dictionary_encode()
    distinct = held.dictionary.to_numpy()
    order = np.argsort(distinct)
    number = np.empty(len(distinct), np.int32)
    number[order] = np.arange(len(distinct), dtype=np.int32)
    return number[held.indices.to_numpy()], distinct[order]


def number_words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all pieces in a row, words per piece, and the distinct words in ascending order."""
    texts = pa.array([p[ORDER:] for p in pieces], pa.binary()).view(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy()
    full = pc.not_equal(flat, "")  # white space at an end leaves an empty part
    of = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    held = flat.filter(full).dictionary_encode()
    distinct = held.dictionary.view(pa.binary())
    order = pc.sort_indices(distinct)
    number = np.empty(len(distinct), np.int32)
    number[order.to_numpy()] = np.arange(len(distinct), dtype=np.int32)
    return number[held.indices.to_numpy()], np.bincount(of, minlength=len(sizes)), distinct.take(order).to_pylist()


def packed(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def gram_ranges(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Grams that share the last three bytes of their context share a range."""
    return ((((grams >> 8) & 0xFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 7) % ranges


def by_range(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places in ascending order) of all ranges that occur."""
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else []
    for places in np.split(order, first[1:]) if len(of) else ():
        yield int(of[places[0]]), places


def word_ranges(words: list[bytes], ranges: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % ranges for w in words], np.int64)


STATS = "block int, range int, kind string, n int, keys binary, counts binary, low_key long, low_n long"


def block_stats(ranges: int):
    """Distinct grams and words of a block with their counts in training pieces (0 where only others have them), parcelled
    by range, and its counts of the grams of order LOW."""

    def run(group: pa.Table) -> pa.Table:
        pieces, last, train = (group.column(c).to_pylist() for c in ("piece", "last", "train"))
        train = np.array(train)
        held = Block(pieces, last)
        at, grams = held.codes()
        n = np.bincount(at[np.repeat(train, held.sizes)], minlength=len(grams))
        rows = []
        for r, places in by_range(gram_ranges(grams, ranges)):
            rows.append((r, "gram", len(places), packed(np.diff(grams[places], prepend=0), ORDER + 1), packed(n[places], 4), None, None))
        numbers, sizes, words = number_words(pieces)
        m = np.bincount(numbers[np.repeat(train, sizes)], minlength=len(words))
        for r, places in by_range(word_ranges(words, ranges)):
            rows.append((r, "word", len(places), pa.compress(b"\n".join(words[i] for i in places), codec="zstd", asbytes=True), packed(m[places], 4), sum(len(words[i]) + 1 for i in places) - 1, None))
        keys, where = np.unique(grams & ((1 << 8 * (LOW + 1)) - 1), return_inverse=True)
        rows += [(None, "low", None, None, None, k, c) for k, c in zip(keys.tolist(), np.bincount(where, n, len(keys)).astype(np.int64).tolist(), strict=True)]
        block = group.column("block")[0].as_py()
        types = pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.table([pa.array([block] * len(rows), pa.int32()), *columns], ["block", "range", "kind", "n", "keys", "counts", "low_key", "low_n"])

    return run


ANSWERS = "block int, range int, kind string, n int, answer binary, total long, distinct long"


def answer_range(low):
    """To every block what it asked for in one range: log10 probabilities of its grams, counts of its words."""

    def run(group: pa.Table) -> pa.Table:
        rows, total, distinct = [], 0, 0
        parcels = group.select(["block", "range", "kind", "n", "keys", "counts", "low_key"]).to_pylist()
        grams = [x for x in parcels if x["kind"] == "gram"]
        if grams:
            keys = [np.cumsum(unpacked(x["keys"], x["n"], ORDER + 1)) for x in grams]
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate([unpacked(x["counts"], x["n"], 4) for x in grams]), len(every)).astype(np.int64)
            log = gram_log10(every, n, *low.value)[at].astype("<f4")
            for x, part in zip(grams, np.split(log, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                rows.append((x["block"], x["range"], "gram", x["n"], pa.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True), None, None))
        asked = [(x, pa.decompress(x["keys"], x["low_key"], codec="zstd", asbytes=True).split(b"\n"), unpacked(x["counts"], x["n"], 4)) for x in parcels if x["kind"] == "word"]
        count: dict[bytes, int] = {}
        for _, words, n in asked:
            for w, c in zip(words, n.tolist(), strict=True):
                count[w] = count.get(w, 0) + c
        for x, words, _ in asked:
            rows.append((x["block"], x["range"], "word", x["n"], packed(np.array([count[w] for w in words]), 6), None, None))
        total, distinct = sum(count.values()), sum(c > 0 for c in count.values())
        rows.append((None, None, "sums", None, None, total, distinct))
        types = pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in ANSWERS.split(", ")])

    return run


def by_context(keys: np.ndarray, n: np.ndarray, order: int) -> dict[str, np.ndarray]:
    """Aggregates of one order. ``keys`` are context and symbol, sorted; ``n`` may be 0 for what training lacks."""
    context = keys >> 8
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, int)
    return {"keys": keys, "n": n, "context": context[first], "total": np.add.reduceat(n, first) if len(first) else n[:0], "distinct": np.add.reduceat((n > 0).astype(np.int64), first) if len(first) else n[:0], "of": np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))}


def shorten(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the next shorter context, their counts, and the place of each longer key among them."""
    short, at = np.unique(keys & ((1 << 8 * order) - 1), return_inverse=True)
    return short, np.bincount(at, n, len(short)).astype(np.int64), at


def gram_log10(grams: np.ndarray, n: np.ndarray, low_keys: np.ndarray, low_n: np.ndarray, low_order: int = LOW) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    ``grams`` holds every gram that shares a context of order 3 with one of them; ``low_keys`` and ``low_n`` are the
    corpus-wide table of order ``low_order``, from which the shorter orders follow.
    """
    out = np.zeros(len(grams))
    if not len(grams):
        return out
    sort = np.argsort(grams)
    keys, counts = grams[sort], n[sort]
    request = np.arange(len(grams))  # place of each gram among the keys of the current order
    open_, logs = np.ones(len(grams), bool), np.zeros(len(grams))
    gone_total, gone_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for order in range(ORDER, -1, -1):
        level = by_context(keys, counts, order)
        of = level["of"][request]
        total, distinct = level["total"][of] - gone_total, level["distinct"][of] - gone_distinct
        hits = level["n"][request]
        rest = np.maximum(total, 1)
        found = open_ & (hits > 0)
        logs[found] += np.log10((hits[found] - 0.5) / rest[found])
        escape = open_ & ~found & (distinct > 0)
        logs[escape] += np.log10(distinct[escape] / 2 / rest[escape])
        open_ &= ~found
        seen_distinct = level["distinct"][of]
        if order == 0:
            break
        if order - 1 == low_order:
            shorter = keys & ((1 << 8 * order) - 1)
            place = np.searchsorted(low_keys, shorter)
            next_keys, next_n = low_keys, low_n
        else:
            next_keys, next_n, place = shorten(keys, counts, order)
        followers = np.bincount(level["of"], np.where(level["n"] > 0, next_n[place], 0), len(level["context"])).astype(np.int64)
        gone_total, gone_distinct = followers[of], seen_distinct
        request, keys, counts = place[request], next_keys, next_n
    logs[open_] += np.log10(1 / np.maximum(ALPHABET - seen_distinct[open_], 1))
    out[sort] = logs
    return out


SCORES = "row long, n_tokens long, n_known long, word_log double, score double, ends boolean"


def score_block(ranges: int, smooth):
    """Sums of a block's pieces: tokens, known tokens, smoothed word scores, model scores."""

    def run(key, pieces: pa.Table, answers: pa.Table) -> pa.Table:
        held, last = pieces.column("piece").to_pylist(), pieces.column("last").to_pylist()
        got = {(x["kind"], x["range"]): (x["n"], x["answer"]) for x in answers.select(["kind", "range", "n", "answer"]).to_pylist()}
        block = Block(held, last)
        at, grams = block.codes()
        by_gram = np.empty(len(grams))
        for r, places in by_range(gram_ranges(grams, ranges)):
            n, blob = got["gram", r]
            by_gram[places] = np.ascontiguousarray(np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<f4").ravel()
        score = sums_of(by_gram[at], block.sizes)
        numbers, sizes, words = number_words(held)
        counts = np.empty(len(words), np.int64)
        for r, places in by_range(word_ranges(words, ranges)):
            n, blob = got["word", r]
            counts[places] = unpacked(blob, n, 6)
        return pa.table({
            "row": pieces.column("row"),
            "n_tokens": pa.array(sizes + np.array(last, np.int64), pa.int64()),
            "n_known": pa.array(sums_of((counts > 0)[numbers].astype(np.int64), sizes)),
            "word_log": pa.array(sums_of(smooth(counts)[numbers], sizes)),
            "score": pa.array(score),
            "ends": pa.array(last, pa.bool_()),
        })

    return run


def sums_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes, some of which may be 0."""
    out = np.zeros(len(sizes), x.dtype)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[full])
    return out


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` tells whom to learn from."""
    spark = docs.sparkSession
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")).alias("b"), F.count_if(train).alias("ends"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-size["b"] // block_bytes))
    ranges = max(32, 2 * blocks)
    pieces = pieces_of(docs, train, blocks, id_col, text_col)
    stats = materialize(pieces.groupBy("block").applyInArrow(block_stats(ranges), STATS), "lm-stats")
    low = stats.where("kind = 'low'").groupBy("low_key").agg(F.sum("low_n").alias("n")).toPandas().sort_values("low_key")  # at most 257**3 rows
    shared = spark.sparkContext.broadcast((low["low_key"].to_numpy(np.int64), low["n"].to_numpy(np.int64)))
    answers = materialize(stats.where("kind <> 'low'").groupBy("range").applyInArrow(answer_range(shared), ANSWERS), "lm-answers")
    sums = answers.where("kind = 'sums'").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    ends = size["ends"]
    train_tokens, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    smooth = lambda c: np.log10((c + 0.1) / (train_tokens + 0.1 * (distinct + 1)))
    scored = pieces.groupBy("block").cogroup(answers.where("kind <> 'sums'").groupBy("block")).applyInArrow(score_block(ranges, smooth), SCORES)
    # rows alike in id and text give the same sums, so all of them together are divided by their number, the ends they have
    by_row = scored.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "word_log", "score")], F.count_if("ends").alias("copies"))
    row = F.xxhash64(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return (
        docs.select(F.col(id_col), (~train).alias("held_out"), row.alias("row"))
        .join(by_row, "row")
        .select(
            id_col,
            "held_out",
            (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
            ((F.col("n_known") / F.col("copies")).cast("long") + F.lit(1 if ends else 0)).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            (F.col("word_log") / F.col("copies") + F.lit(float(smooth(ends)))).alias("base_score"),
            (F.col("score") / F.col("copies")).alias("score"),
        )
    )
