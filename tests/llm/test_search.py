"""Vector search and decontamination against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, queries
from orrery.llm.decontaminate import ItemIndex, find_leaks, overlap, question_and_answer, runs, runs_of_all_sizes, words


def recall(got, ids, x, asks, k=20):
    found, wanted = {}, 0
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for i in np.flatnonzero(asks):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        mine = sorted(found.get(ids[i], []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        for a, b in zip(mine, mine[1:], strict=False):
            assert (-a[2], a[1]) < (-b[2], b[1])
        place = {v: j for j, v in enumerate(ids)}
        for _, v, s in mine:
            assert s == pytest.approx(score[place[v]], rel=1e-12, abs=1e-12)
        hit += len({v for _, v, _ in mine} & set(ids[best]))
        wanted += len(best)
    return hit / wanted


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_search_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    assert recall(queries.op3_vector_search(spark, f"/root/testdata/{sf}").collect(), ids, x, ids % 20 == 0) >= 0.95


def test_search_recall_in_many_lists(spark, monkeypatch):
    """Vectors without directions in 93 lists on 12 shelves: a fixed number of probes loses true neighbours."""
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "SHELF_ROWS", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    x, ids = np.random.default_rng(5).normal(size=(6000, 32)), np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert recall(ann.search(df, F.col("vec_id") % 20 == 0).collect(), ids, x, ids % 20 == 0) >= 0.95


def test_search_recall_of_fifty_thousand(spark, monkeypatch):
    """Vectors around 200 directions at the true list size: far fewer lists are probed than there are, recall holds."""
    probed = []
    monkeypatch.setattr(ann, "probes_needed", lambda indexed, queries, space, *a, f=ann.probes_needed: probed.append((f(indexed, queries, space, *a), len(space.centres))) or probed[-1][0])
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(200, 64))[rng.integers(0, 200, 51_200)] + 0.3 * rng.normal(size=(51_200, 64)), np.arange(51_200)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}))
    assert recall(ann.search(df, F.col("vec_id") % 200 == 0).collect(), ids, x, ids % 200 == 0) >= 0.95
    assert probed[0][1] == 100 and probed[0][0] < 50


def test_scan_finds_the_nearest_of_probed_lists():
    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(400, 40)), rng.normal(size=(30, 40))
    lists = np.sort(rng.integers(0, 7, 400))
    cut = np.searchsorted(lists, np.arange(8))
    probed = [rng.permutation(7)[: rng.integers(1, 8)] for _ in asked]
    q, r = ann.scan(asked, probed, rows, {i: (int(cut[i]), int(cut[i + 1])) for i in range(7)}, 5)
    hit = 0
    for i, p in enumerate(probed):
        inside = np.flatnonzero(np.isin(lists, p))
        mine = r[q == i]
        assert set(mine) <= set(inside) and len(mine) == 5
        hit += len(set(mine) & set(inside[((rows[inside] - asked[i]) ** 2).sum(1).argsort()[:5]]))
    assert hit >= 0.95 * 150


def test_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHELF_ROWS", 5)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), *[(i, [0.1, 0.1]) for i in range(20, 40)]]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    first = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0]
    assert first[:2] == [(1, 0.5), (2, 0.5)] and {r["query_id"] for r in got} == {0, 20}
    assert [r["vec_id"] for r in got if r["query_id"] == 20 and r["rank"] <= 4][:2] in ([0, 0], [0, 1])
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_search_with_a_repeated_id(spark, monkeypatch):
    """A query's id a thousand times, alike and unlike: spread over shelves, its rows are candidates of others, never its own."""
    monkeypatch.setattr(ann, "SHELF_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ann, "SCANNED", 7)
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(1, 8)) * 3, 600, axis=0), rng.normal(size=(400, 8))]), 3)
    ids = np.r_[np.arange(400), np.full(1000, 40)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 400, 20):
        v = min(map(tuple, x[ids == q]))
        others = ids != q
        score = x[others] @ np.array(v)
        best = np.lexsort((ids[others], -score))[:20]
        want = list(zip(ids[others][best].tolist(), score[best].tolist(), strict=True))
        assert len(got[q]) == 20 and all(i != q for i, _ in got[q])
        hit += sum(a[0] == b[0] and a[1] == pytest.approx(b[1]) for a, b in zip(got[q], want, strict=True))
    assert hit / 400 >= 0.95


def by_hand(texts, items, threshold=0.5, question=0.6, answer=0.6):
    """BM25 of every item for every window, by definition."""
    items = [(i, t) for i, t in items if t and words(t)]
    bags = [words(t) for _, t in items]
    n, mean = len(items), np.mean([len(w) for w in bags])
    window = 2 * max([32, *map(len, bags)])

    def score(k, query):
        total = 0
        for t in set(bags[k]) & query:
            df, tf = sum(t in w for w in bags), bags[k].count(t)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bags[k]) / mean))
        return total

    own = [score(k, set(bags[k])) for k in range(n)]
    out = {}
    for doc, text in texts:
        w = words(text or "")
        for a in range(0, max(1, len(w) - window // 2), window // 2):
            passage = w[a : a + window]
            for k, (item, t) in enumerate(items):
                s = score(k, set(passage)) / own[k]
                q, r = (overlap(runs(p), runs_of_all_sizes(passage)) for p in question_and_answer(t))
                if s >= threshold and q >= question and r >= answer:
                    out[doc, item] = max(out.get((doc, item), 0), s)
    return out


def test_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["bm25"] for r in queries.op7_decontamination(spark, sf).collect()}
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)


def test_leaks_in_hard_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    speak = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{speak(rng.integers(8, 40))}. {speak(rng.integers(2, 12))}.") for i in range(30)] + [(30, None), (31, ""), (32, "?!"), (33, "Alone"), (34, "same item here. yes"), (35, "same item here. yes")]
    texts = [(None, None), (1, ""), (2, "..."), (3, "same ITEM -- here; yes")]
    for i in range(4, 60):
        item = items[rng.integers(30)][1].split()
        for _ in range(rng.integers(0, 12)):
            item[rng.integers(len(item))] = rng.choice(vocabulary)
        texts.append((i, f"{speak(rng.integers(0, 300))} {' '.join(item).upper()} {speak(rng.integers(0, 300))}"))
    texts += [(3, "same item here yes"), (100, speak(20000))]
    docs = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, item_id string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["bm25"] for r in find_leaks(docs, frame).collect()}
    want = by_hand(texts, items)
    assert got.keys() == want.keys() and {(3, 34), (3, 35)} <= got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert find_leaks(docs.limit(0), frame).count() == 0 and find_leaks(docs, frame.limit(0)).count() == 0


def test_leaks_in_several_shards(spark, monkeypatch):
    """Every item is found in the shard that holds it, and the driver is left with none of them."""
    from orrery.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 4)
    items = [(i, f"what is the number {chr(97 + i) * 4} of thing {chr(97 + i) * 3}. it is {chr(97 + i) * 5} and more") for i in range(14)] + [(None, "an item without a name here. yes it is")]
    docs = spark.createDataFrame([(i or -1, f"before {t} after") for i, t in items], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(i or -1, i) for i, _ in items}


def test_wand_finds_what_full_scoring_finds():
    rng = np.random.default_rng(9)
    index = ItemIndex([(i, " ".join(f"t{k}" for k in rng.integers(0, 60, 8))) for i in range(100)], 0.3)
    for _ in range(50):
        query = np.unique(rng.integers(0, len(index.terms), 12))
        scores = np.zeros(100)
        for t in query:
            scores[index.items[t]] += index.weights[t]
        hits = index.wand(query, index.block_sums(np.zeros(len(query), int), query, 1)[0] >= 0.3 - 1e-6)
        assert {i for i, _ in hits} == set(np.flatnonzero(scores >= 0.3 - 1e-9)) and all(s == pytest.approx(scores[i]) for i, s in hits)
