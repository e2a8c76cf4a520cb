"""Language identification by a convolutional network over byte windows.

A text is lower-cased and turned into UTF-8; ASCII letters and all bytes above ASCII are symbols of their own, and a run of
anything else is one gap. The symbols are cut into windows of fixed length (the last one padded with gaps). Filters of several
widths run over embedded symbols, each filter keeps its maximum, and a softmax layer gives a distribution over languages.
A text's distribution is the softmax of the mean log-probabilities of its windows, weighted by the symbols they hold.

The network is trained in numpy on the driver with at most ``per_language`` texts of each language and at most
``windows_per_text`` windows of each text, spread evenly over it; both bounds are parameters and hold at every input size.
Prediction covers every window of every text, in batches of bounded size, in tasks that hold one text at a time.

On request the network learns one more class, *junk*: made windows without language, of symbols drawn at random from alphabets
of random size, in the manner of key mashing, digests, and scripts that no labelled text has. It never is a prediction;
its probability beside all languages is a column of its own, so that a caller can reject a text, however many languages there are.

Defined results: null texts and texts without a letter (Unicode category L) are ``und`` with score 0, and so is everything if no labelled text
is given; a text of any length is read whole; ties go to the language that sorts first; repeated rows are returned as often
as they come; an empty table gives an empty result; columns pass through, and added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of

SYMBOLS = 27 + 128
#: Byte to symbol: 0 is a gap, 1 to 26 are letters, the rest are bytes above ASCII.
TABLE = np.array([b - 96 if 97 <= b <= 122 else b - 128 + 27 if b >= 128 else 0 for b in range(256)], np.uint8)
BATCH_BYTES = 8 << 20
BLOCK_WINDOWS = 256


def symbols(text: str) -> np.ndarray:
    x = TABLE[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    return x[keep]


def windows(text: str, length: int) -> np.ndarray:
    x = symbols(text)
    n = max(1, -(-len(x) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(x)] = x
    return out.reshape(n, length)


def junk_windows(n: int, length: int, seed: int = 5) -> np.ndarray:
    """Windows without language: random symbols of a random alphabet, among letters, all symbols, or lead and trailing bytes."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, length), np.uint8)
    for i in range(n):
        gaps = rng.uniform(0, 0.6)
        if i % 4 == 2:  # characters of two or three bytes in few leading ones
            trail = rng.integers(1, 3)
            x = 27 + rng.choice(rng.integers(0, 64, rng.integers(8, 64)), 4 * length)
            x[:: trail + 1] = 27 + rng.choice(rng.integers(66, 116, rng.integers(1, 4)), len(x[:: trail + 1]))
        elif i % 4 == 3:  # hexadecimal digits, of which only letters are symbols
            x, gaps = rng.integers(1, 7, 4 * length), 10 / 16
        else:
            x = rng.choice(rng.integers(1, [27, SYMBOLS][i % 4], rng.integers(3, 60)), 4 * length)
        x[rng.random(len(x)) < gaps] = 0
        x = x[(x > 0) | np.r_[False, x[:-1] > 0]][: rng.choice([length, rng.integers(16, length)], p=[0.7, 0.3])]  # a run of gaps is one
        out[i, : len(x)] = x
    return out


class ByteNet:
    """Embedding, filters of several widths with max pooling, softmax over the languages and, if there is one, junk."""

    def __init__(self, languages: list[str], widths=(2, 3, 4), filters: int = 12, embedding: int = 8, length: int = 64, seed: int = 0, junk: bool = False):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.length, self.junk = languages, widths, length, junk
        classes = len(languages) + junk
        self.p = {"emb": rng.normal(0, 0.5, (SYMBOLS, embedding)), "out": rng.normal(0, 0.2, (len(widths) * filters, classes)), "bias": np.zeros(classes)}
        for w in widths:
            self.p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * embedding), (w, embedding, filters)), f"b{w}": np.zeros(filters)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, ids: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch."""
        p, n = self.p, len(ids)
        x, rows = p["emb"][ids], np.arange(n)[:, None]
        pooled, best = [], []
        for w in self.widths:
            span = self.length - w + 1
            conv = sum(x[:, j : j + span] @ p[f"w{w}"][j] for j in range(w))
            at = conv.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0] + p[f"b{w}"])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), label] + 1e-9).mean())
        q[np.arange(n), label] -= 1
        q /= n
        grad = {"out": h.T @ q, "bias": q.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (q @ p["out"].T) * (h > 0)
        for i, w in enumerate(self.widths):
            k = p[f"b{w}"].shape[0]
            d = dh[:, i * k : (i + 1) * k]
            grad[f"b{w}"] = d.sum(0)
            grad[f"w{w}"] = np.empty_like(p[f"w{w}"])
            for j in range(w):
                at = ids[rows, best[i] + j]
                grad[f"w{w}"][j] = np.einsum("nfe,nf->ef", p["emb"][at], d)
                np.add.at(grad["emb"], at, d[:, :, None] * p[f"w{w}"][j].T[None])
        return loss, grad

    def fit(self, ids: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 1) -> None:
        """Adam over shuffled batches."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(ids), batch):
                some = order[i : i + batch]
                _, grad = self.step(ids[some], label[some])
                t += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * 0.7**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs by pairs of symbols at offsets 0 and 2, for all filters side by side: two look-ups a position."""
        if max(self.widths) > 4 or min(self.widths) < 2:
            raise ValueError("widths from 2 to 4 only")
        halves = []
        for first in (0, 2):
            parts = []
            for w in self.widths:
                one = [self.p["emb"] @ self.p[f"w{w}"][j] if j < w else np.zeros((SYMBOLS, self.p[f"b{w}"].shape[0]), np.float32) for j in (first, first + 1)]
                parts.append((one[0][:, None] + one[1][None]).reshape(SYMBOLS * SYMBOLS, -1))
            halves.append(np.concatenate(parts, 1))
        return halves[0], halves[1]

    def log_probabilities(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        bias = np.concatenate([self.p[f"b{w}"] for w in self.widths])
        out = np.empty((len(ids), len(self.p["bias"])), np.float32)
        lack = self.length - max(self.widths) + 1
        for i in range(0, len(ids), BLOCK_WINDOWS):
            x = ids[i : i + BLOCK_WINDOWS].astype(np.int32)
            pair = x[:, :-1] * SYMBOLS + x[:, 1:]
            top = (tables[0][pair[:, :lack]] + tables[1][pair[:, 2:]]).max(1)
            # narrower filters have a few more places at the end of the window
            k = len(bias) // len(self.widths)
            for j, w in enumerate(self.widths):
                for at in range(lack, self.length - w + 1):
                    late = tables[0][pair[:, at], j * k : (j + 1) * k]
                    if w == 3:
                        late = late + tables[1][x[:, at + 2] * SYMBOLS, j * k : (j + 1) * k]
                    top[:, j * k : (j + 1) * k] = np.maximum(top[:, j * k : (j + 1) * k], late)
            z = np.maximum(top + bias, 0) @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            out[i : i + BLOCK_WINDOWS] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def train(labelled: DataFrame, per_language: int = 1000, windows_per_text: int = 8, length: int = 64, junk: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Fit on the texts with the smallest hashes of id and text of each language; None if nothing is labelled."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    # hashes are uniform: a share of each language's that holds somewhat more than the wanted number is ranked, whatever its size
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.approx_count_distinct("h")).alias("share"))  # a row a language
    few = usable.join(F.broadcast(share), "lang").where(F.col("h") <= F.col("share") * 2.0**64 - 2.0**63).select("lang", "h", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                w = windows(text, length)
                rows.append([w[i].tobytes() for i in np.unique(np.linspace(0, len(w) - 1, windows_per_text).astype(int))])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(rows, pa.list_(pa.binary()))], ["lang", "h", "windows"])

    held = few.mapInArrow(cut, "lang string, h long, windows array<binary>").dropDuplicates(["lang", "h"])
    chosen = held.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_language)

    # at most languages x per_language x windows_per_text windows of `length` bytes; sorted, so that training is repeatable
    sample = chosen.select("lang", F.explode("windows").alias("window")).toPandas().sort_values(["lang", "window"])
    if not len(sample):
        return None
    languages = sorted(sample["lang"].unique())
    ids = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(len(sample), length)
    label = np.searchsorted(languages, sample["lang"].to_numpy())
    if junk:
        made = junk_windows(max(len(ids) // len(languages), 200), length)
        ids, label = np.concatenate([ids, made]), np.r_[label, np.full(len(made), len(languages))]
    net = ByteNet(languages, length=length, junk=junk)
    net.fit(ids, label)
    return net


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and if the network knows junk, its probability ``junk`` and ``n_symbols``."""
    added = {"lang_pred": pa.string(), "score": pa.float64()} | ({"junk": pa.float64(), "n_symbols": pa.int64()} if net is not None and net.junk else {})
    docs = docs.drop(*added)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value, None
        for batch in rows_of(batches, BATCH_BYTES, text_col):
            if net is not None and tables is None:
                tables = net.tables()
            texts = batch.column(text_col).to_pylist()
            out = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "junk": [0.0] * len(texts), "n_symbols": [0] * len(texts)}
            read = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
            if read:
                cut = [windows(texts[i], net.length) for i in read]
                every = np.concatenate(cut)
                held = (every > 0).sum(1)
                weight = held + 1e-3
                starts = np.cumsum([0, *map(len, cut[:-1])])
                z = np.add.reduceat(net.log_probabilities(every, tables) * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                q = np.exp(z - z.max(1, keepdims=True))
                of = q[:, : len(net.languages)]
                score = of.max(1) / np.maximum(of.sum(1), np.finfo(float).tiny)
                for i, k, x, j, n in zip(read, of.argmax(1), score, 1 - of.sum(1) / q.sum(1), np.add.reduceat(held, starts), strict=True):
                    out["lang_pred"][i], out["score"][i], out["junk"][i], out["n_symbols"][i] = net.languages[k], float(x), float(j), int(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[c], t) for c, t in added.items())], [*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = {"lang_pred": "string", "score": "double", "junk": "double", "n_symbols": "long"}
    return docs.mapInArrow(run, ", ".join([*([fields] if fields else []), *(f"{c} {kinds[c]}" for c in added)]))
