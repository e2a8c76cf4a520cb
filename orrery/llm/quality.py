"""Quality classifier: rules from tree paths, weighted by a lasso, compiled to column expressions.

``describe_texts`` describes texts by some numbers, over the bytes of a whole Arrow batch at a time. On a bounded sample of labelled rows small trees are grown,
one after the other on what the earlier ones leave unexplained; the path to each of their nodes is a rule, a conjunction of bounds on
statistics. A logistic regression with an L1 penalty over all rules keeps a few of them (``MOST_RULES`` at most), each with a weight. A model is
nothing but these rules, and ``RuleModel.score`` is one Spark expression over the statistics.

The sample: of each label the ``PER_LABEL`` labelled ids of least hash, so at most twice that many rows, weighted back to the share of
their label among all labels. If documents repeat an id, at most ``PER_LABEL`` rows of a label are taken, by the hash of id and text.

Defined results: a null text is the empty one; it and texts without words get a score like any other; labels that are neither 0 nor 1
or have no id teach nothing; of several labels of an id the least holds; rows of equal texts have equal scores; without any labelled
document the score is 0.5 (predicted 1), with one label only (n + 1) / (n + 2) or 1 / (n + 2); an empty table gives no rows. Whole texts
are read, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of

PER_LABEL = 4000
MOST_RULES = 32
BATCH_BYTES = 8 << 20
TREES, DEPTH, BINS, LEAST_SUPPORT = 30, 3, 24, 10
#: Penalties that are tried, as shares of the one that leaves no rule.
PENALTIES = (0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002)
#: Kinds of bytes: small letters (with the first bytes of other characters), capitals, digits, stops, exclamation marks, white space and
#: brackets, bytes that go on with a character; the last kind is whatever is in none of them.
SETS = (bytes([*range(97, 123), *range(0xC0, 0x100)]), bytes(range(65, 91)), b"0123456789", b".,;:?", b"!", b" \t\n\x0b\x0c\r'\"()-", bytes(range(0x80, 0xC0)))
KINDS = np.full(256, len(SETS), np.uint8)
for _k, _s in enumerate(SETS):
    KINDS[list(_s)] = _k
NAMES = ("characters", "letters", "capitals", "digits", "stops", "shouts", "signs", "word_size", "distinct_words", "words_a_line", "distinct_lines")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks of each text, given where texts begin and end among all bytes."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _pieces(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that are not empty and different ones among them, for each text."""
    piece, text = lists.flatten(), pc.list_parent_indices(lists)
    held = pc.not_equal(piece, "")
    piece, text = piece.filter(held).dictionary_encode(), text.filter(held).to_numpy().astype(np.int64)
    different = np.unique(text * max(len(piece.dictionary), 1) + piece.indices.to_numpy()) // max(len(piece.dictionary), 1)
    return np.bincount(text, minlength=len(lists)), np.bincount(different, minlength=len(lists))


def describe_texts(texts: pa.StringArray) -> np.ndarray:
    """The statistics of each text, in the order of ``NAMES``. A character beyond ASCII counts as a letter; shares of nothing are 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kind = KINDS[raw]
    n = [_per_text(kind == k, offsets - offsets[0]) for k in range(len(SETS) + 1)]
    small, capital, digit, stop, shout, space, follows, sign = n
    size, letters = np.diff(offsets) - follows, small + capital
    words, different_words = _pieces(pc.ascii_split_whitespace(texts))
    lines, different_lines = _pieces(pc.split_pattern(texts, "\n"))
    return np.column_stack([
        np.log1p(size), _share(letters, size), _share(capital, letters), _share(digit, size), _share(stop, size), _share(shout, size), _share(sign, size),
        _share(letters, words), _share(different_words, words), _share(words, lines), _share(different_lines, lines),
    ])


def measure(docs: DataFrame, carry: str) -> DataFrame:
    """``carry`` and the statistics of ``text`` of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, BATCH_BYTES, "text"):
            x = describe_texts(b.column("text"))
            yield pa.record_batch([b.column("id"), *[pa.array(x[:, j]) for j in range(len(NAMES))]], names=["id", *NAMES])

    rows = docs.select(F.col(carry).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, T.StructType([rows.schema["id"], *[T.StructField(c, T.DoubleType()) for c in NAMES]]))


@dataclass(frozen=True)
class Rule:
    """Statistics' bounds: (name, above, up to), with infinities where open."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.bounds:
            v = x[:, NAMES.index(name)]
            out &= (v > low) & (v <= high)
        return out

    def column(self) -> Column:
        out = None
        for name, low, high in self.bounds:
            for c in ([F.col(name) > F.lit(low)] if np.isfinite(low) else []) + ([F.col(name) <= F.lit(high)] if np.isfinite(high) else []):
                out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 from the columns that ``measure`` makes."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def describe(self) -> list[tuple[str, float]]:
        return [(" and ".join(f"{low:.4g} < {n} <= {high:.4g}" for n, low, high in r.bounds), w) for r, w in self.rules]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _grow(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> list[tuple[dict, np.ndarray, float]]:
    """A tree of Newton steps: (bounds by statistic, rows, step) for every node but the root."""
    out, level = [], [({}, np.arange(len(x)))]
    for _ in range(DEPTH):
        below = []
        for bounds, rows in level:
            g, w = gradient[rows], weight[rows]
            whole = g.sum() ** 2 / (w.sum() + 1)
            best = (1e-9, None)
            for j in columns:
                if not len(edges[j]):
                    continue
                at = np.searchsorted(edges[j], x[rows, j])  # v <= edges[at]
                n = len(edges[j]) + 1
                gs, ws, cs = (np.bincount(at, v, n).cumsum()[:-1] for v in (g, w, np.ones(len(rows))))
                gain = gs**2 / (ws + 1) + (g.sum() - gs) ** 2 / (w.sum() - ws + 1) - whole
                gain[(cs < LEAST_SUPPORT) | (len(rows) - cs < LEAST_SUPPORT)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, edges[j][k]))
            if best[1] is None:
                continue
            j, cut = best[1]
            low, high = bounds.get(j, (-np.inf, np.inf))
            under = x[rows, j] <= cut
            for b, r in (({**bounds, j: (low, cut)}, rows[under]), ({**bounds, j: (cut, high)}, rows[~under])):
                below.append((b, r))
                out.append((b, r, gradient[r].sum() / (weight[r].sum() + 1)))
        level = below
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees as rules; each tree sees half of the statistics, so that paths differ."""
    rng = np.random.default_rng(seed)
    edges = []
    for j in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1), method="lower"))
        edges.append(v[:-1])
    z = np.full(len(x), np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = _sigmoid(z)
        tree = _grow(x, edges, weight * (y - p), np.maximum(weight * p * (1 - p), 1e-6), rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
        step = np.zeros(len(x))
        for bounds, rows, value in tree:  # deeper nodes come later and overwrite
            rules[Rule(tuple((NAMES[j], *b) for j, b in sorted(bounds.items())))] = None
            step[rows] = value
        z += 0.3 * np.clip(step, -4, 4)
    return list(rules)


def lasso(m: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(m)), m])
    share = weight / weight.sum()
    step = 4 / np.linalg.norm(a * np.sqrt(share)[:, None], 2) ** 2
    b = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = v - step * (a.T @ (share * (_sigmoid(a @ v) - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, b = new + (old - 1) / t * (new - b), new
    return float(b[0]), b[1:]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> RuleModel:
    """The model of a sample in memory: statistics, labels and weights of its rows."""
    if not len(y) or y.min() == y.max():
        ones = float(y.sum())
        return RuleModel(float(np.log((ones + 1) / (len(y) - ones + 1))), ())
    rules = tree_rules(x, y, weight)
    m = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    share = weight / weight.sum()
    top = np.abs(m.T @ (share * (y - (share * y).sum()))).max() if rules else 0.0
    check = np.arange(len(y)) % 3 == 0
    best = (np.inf, 1.0)
    for part in PENALTIES:
        b0, b = lasso(m[~check], y[~check], weight[~check], part * top)
        if (b != 0).sum() > MOST_RULES:
            break
        p = np.clip(_sigmoid(b0 + m[check] @ b), 1e-6, 1 - 1e-6)
        loss = -(share[check] * (y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))).sum()
        best = min(best, (loss, part))
    part = best[1]
    while True:
        b0, b = lasso(m, y, weight, part * top)
        if (b != 0).sum() <= MOST_RULES:
            return RuleModel(b0, tuple((rules[k], float(b[k])) for k in np.flatnonzero(b)))
        part *= 1.3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> RuleModel:
    """Learn ``label`` from the labelled among ``docs`` (doc_id, text)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    # only labels of these documents; ids alone are joined
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    many = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    xs, ys, weights = [], [], []
    for y, n in sorted(many.items()):
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).select("doc_id")
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
        rows = measure(rows.withColumn("h", F.xxhash64("doc_id", "text")), "h").orderBy("id", *NAMES).limit(per_label)
        x = rows.select(*NAMES).toPandas().to_numpy(float)
        xs.append(x)
        ys.append(np.full(len(x), float(y)))
        weights.append(np.full(len(x), n / max(len(x), 1)))
    if not xs:
        return RuleModel(0.0, ())
    x, y, w = np.concatenate(xs), np.concatenate(ys), np.concatenate(weights)
    return fit(x, y, w / w.mean())


def assess(docs: DataFrame, model: RuleModel, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every document; other columns are not carried."""
    return measure(docs, id_col).select(F.col("id").alias(id_col), model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
