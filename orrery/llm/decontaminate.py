"""Benchmark decontamination: BM25 retrieval of test items by every passage, then overlap checks.

The test items are the index, every passage of every text is a query. A passage is a window of words twice as long as the
longest item, and windows advance by half their length, so each item fits whole in one of them.

Scores are normalised: an item's BM25 score for a passage is divided by its score for itself, so one threshold serves items
of any length. Retrieval returns *all* items at or above the threshold by block-max WAND:
- each term has an upper bound over all items; a running sum of bounds over a text's words rules out most windows at once;
- items are stored in small blocks, each term with its greatest weight in each block that holds it; the sums of a window's block
  bounds, taken for many windows at a time, rule out blocks and mostly whole windows;
- in the blocks that are left, cursors over posting lists sorted by item are moved by pivoting on term bounds, skipping to
  the next block where its bounds fall short, and items at the pivot are scored in full.

A retrieved pair is a leak if the passage holds enough of the item's question and of its answer. The answer is the item's
last sentence and the question what goes before; an item of one sentence is halved. Overlap is the share of distinct
three-word runs (single words for parts shorter than that).

The index of an items table of any size is built in shards of about ``SHARD_ITEMS`` items, dealt by hash. With more than one
shard the texts are read once for each, its finds are written, and its items are freed before the next, so the driver and
the tasks hold one shard at a time.

Words: lower-cased, ASCII punctuation and general punctuation separate. Defined results: null, empty and wordless texts and
items never match; items alike are reported each; a pair of text and item is reported once, with the best passage; repeated
rows are reported once for each id; texts with null ids are read, and reported under a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

SHARD_ITEMS = 20_000
BATCH_BYTES = 4 << 20
K1, B = 1.2, 0.75
BLOCK_ITEMS = 2
#: Block bounds that are summed at a time.
CHUNK = 4_000_000
_TABLE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_PUNCTUATION = re.compile("[‐-‧ «»]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
END = np.iinfo(np.int32).max


def words(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = _PUNCTUATION.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in (words(s) for s in _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [x for s in sentences[:-1] for x in s], sentences[-1]
    w = sentences[0] if sentences else []
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def runs(w: list) -> set[tuple]:
    k = min(3, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


class ItemIndex:
    """Inverted index of items with normalised BM25 weights, their bounds and block bounds."""

    def __init__(self, items: list[tuple], threshold: float):
        self.threshold = threshold
        kept = [(i, words(t)) for i, t in items]
        kept = [(i, w, t) for (i, w), (_, t) in zip(kept, items, strict=True) if w]
        self.ids = [i for i, _, _ in kept]
        self.parts = [[runs(p) for p in question_and_answer(t)] for _, _, t in kept]
        self.terms: dict[bytes, int] = {}
        for _, w, _ in kept:
            for x in w:
                self.terms.setdefault(x, len(self.terms))
        n = len(kept)
        self.window = 2 * max([32, *(len(w) for _, w, _ in kept)])
        mean = np.mean([len(w) for _, w, _ in kept]) if n else 1
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        df = np.zeros(len(self.terms))
        counted = []
        for _, w, _ in kept:
            t, c = np.unique([self.terms[x] for x in w], return_counts=True)
            counted.append((t, c, len(w)))
            df[t] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        for item, (t, c, length) in enumerate(counted):
            weight = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean))
            for x, v in zip(t.tolist(), weight / weight.sum(), strict=True):
                lists[x].append((item, float(v)))
        self.items = [np.array([i for i, _ in p], np.int32) for p in lists]
        self.weights = [np.array([v for _, v in p]) for p in lists]
        #: bound of each term, and one row more for words that no item has
        self.bound = np.array([*(w.max() for w in self.weights), 0.0])
        self.blocks = max(1, -(-n // BLOCK_ITEMS))
        # block bounds, term after term: which blocks hold a term, and its greatest weight there
        at, blocks, most = [0], [], []
        for i, v in zip(self.items, self.weights, strict=True):
            held, first = np.unique(i // BLOCK_ITEMS, return_index=True)
            blocks.append(held)
            most.append(np.maximum.reduceat(v, first))
            at.append(at[-1] + len(held))
        self.block_at, self.block_of, self.block_bound = np.array(at), np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*most, np.zeros(0)])

    def block_sums(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Upper bounds of each window and block from pairs of window and distinct term."""
        start, count = self.block_at[term], self.block_at[term + 1] - self.block_at[term]
        entry = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(np.repeat(window, count) * self.blocks + self.block_of[entry], self.block_bound[entry], n * self.blocks).reshape(n, self.blocks)

    def wand(self, query: np.ndarray, open_blocks: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms of ``query`` reaches the threshold."""
        lists = [[t, 0, self.items[t], self.weights[t]] for t in query.tolist()]
        open_at = np.flatnonzero(open_blocks) * BLOCK_ITEMS
        found, slack = [], self.threshold - 1e-9

        def seek(x, item):
            x[1] += int(np.searchsorted(x[2][x[1] :], item))

        def head(x):
            return int(x[2][x[1]]) if x[1] < len(x[2]) else END

        while True:
            lists.sort(key=head)
            total, pivot = 0.0, None
            for x in lists:
                if head(x) == END:
                    break
                total += self.bound[x[0]]
                if total >= slack:
                    pivot = head(x)
                    break
            if pivot is None:
                return found
            block = pivot // BLOCK_ITEMS
            if not open_blocks[block]:
                # block bounds fall short: on to the next block where they don't
                later = open_at[np.searchsorted(open_at, pivot) :]
                if not len(later):
                    return found
                for x in lists:
                    if head(x) < later[0]:
                        seek(x, later[0])
                continue
            score = 0.0
            for x in lists:
                if head(x) < pivot:
                    seek(x, pivot)
                if head(x) == pivot:
                    score += float(x[3][x[1]])
                    x[1] += 1
            if score >= slack:
                found.append((pivot, score))

    def retrieve(self, terms: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
        """(text, first word, last word, hits) of the windows that reach an item. ``edges`` part the words by text."""
        half = self.window // 2
        sizes = np.diff(edges)
        per = np.maximum(1, -(-(sizes - half) // half))
        of = np.repeat(np.arange(len(sizes)), per)
        first = edges[of] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * half
        last = np.minimum(first + self.window, edges[of + 1])
        sums = np.r_[0.0, np.cumsum(self.bound[terms])]
        left = np.flatnonzero(sums[last] - sums[first] >= self.threshold - 1e-6)
        step, v = max(1, min(512, CHUNK // (16 * self.blocks))), len(self.terms)
        for i in range(0, len(left), step):
            some = left[i : i + step]
            size = last[some] - first[some]
            place = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pair = np.repeat(np.arange(len(some)), size) * (v + 1) + terms[place]
            pair = np.unique(pair[terms[place] < v])
            window, term = pair // (v + 1), pair % (v + 1)
            open_blocks = self.block_sums(window, term, len(some)) >= self.threshold - 1e-6
            for k in np.flatnonzero(open_blocks.any(1)):
                query = term[np.searchsorted(window, k) : np.searchsorted(window, k, "right")]
                if hits := self.wand(query, open_blocks[k]):
                    yield int(of[some[k]]), int(first[some[k]]), int(last[some[k]]), hits


LEAKS = "bm25 double, question_overlap double, answer_overlap double, passage_start long"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, bm25, question_overlap, answer_overlap, passage_start) of every text that holds a test item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    id_type, item_type = docs.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    found = None
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).orderBy("item", "text").collect()  # about SHARD_ITEMS
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in rows_of(batches, BATCH_BYTES, "text"):
                index = index or ItemIndex(shared.value, threshold)
                ids = batch.column("id").to_pylist()
                split = [words(t or "") for t in batch.column("text").to_pylist()]
                edges = np.cumsum([0, *map(len, split)])
                number, other = index.terms.get, len(index.terms)
                terms = np.fromiter((number(w, other) for s in split for w in s), np.int32, edges[-1])
                best: dict[tuple, tuple] = {}
                for text, a, b, hits in index.retrieve(terms, edges) if index.ids else ():
                    passage = split[text][a - edges[text] : b - edges[text]]
                    held = runs_of_all_sizes(passage)
                    for item, score in hits:
                        q, r = (overlap(part, held) for part in index.parts[item])
                        if q >= question and r >= answer and score > best.get((text, item), (0, 0, 0.0))[2]:
                            best[text, item] = (ids[text], index.ids[item], score, q, r, int(a - edges[text]))
                if best:
                    types = [batch.schema.field("id").type, None, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best.values(), strict=True), types, strict=True)], ["id", "item", *[x.split()[0] for x in LEAKS.split(", ")]])

        part = docs.mapInArrow(run, f"id {id_type}, item {item_type}, {LEAKS}")
        if shards > 1:
            part = materialize(part, "leaks")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("bm25", "question_overlap", "answer_overlap", "passage_start"), F.struct("bm25", "passage_start")).alias("best")
    return found.groupBy("id", "item").agg(best).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*")


def runs_of_all_sizes(passage: list[bytes]) -> set[tuple]:
    out = {(w,) for w in passage}
    for k in (2, 3):
        out |= {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
    return out


def overlap(part: set[tuple], held: set[tuple]) -> float:
    """Share of a part's runs that the passage holds; an empty part is held by any."""
    return len(part & held) / len(part) if part else 1.0


def contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """Distinct ids of texts that hold a test item."""
    return find_leaks(docs, items, **settings).select(settings.get("id_col", "doc_id")).distinct()
