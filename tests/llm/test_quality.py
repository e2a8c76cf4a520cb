"""The rule ensemble: statistics and scores against plain Python, lasso against its optimality, held-out accuracy."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm.quality import MOST_RULES, NAMES, RuleModel, assess, describe_texts, fit, lasso, train, tree_rules
from orrery.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain(text):
    share = lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(re.findall(pattern, text))
    letters = count(r"[A-Za-z]") + count(r"[^\x00-\x7F]")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(len(text)), share(letters, len(text)), share(count("[A-Z]"), letters), share(count("[0-9]"), len(text)), share(count("[.,;:?]"), len(text)), share(text.count("!"), len(text)),
        share(count(r"[\x00-\x7F]") - count(r"[A-Za-z0-9.,;:?!\x20\x09-\x0D'\"()-]"), len(text)),
        share(letters, len(words)), share(len(set(words)), len(words)), share(len(words), len(lines)), share(len(set(lines)), len(lines)),
    ]


TEXTS = ["", "a", "  ", "\n\n", "One two, one!\nOne two.\n\nthree\n", "É für 日本 😀 ### &&&", "A" * 100_000 + " b" * 50_000, "12 34\t5\x0b6", " x"]


def test_statistics_equal_plain_python():
    got = describe_texts(pa.array(["skipped", *TEXTS]).slice(1))
    np.testing.assert_allclose(got, [plain(t) for t in TEXTS], rtol=1e-12)


def test_scores_equal_plain_rules(spark):
    model = train(spark.read.parquet(f"{SF}/documents.parquet").limit(3000), spark.read.parquet(f"{SF}/labels.parquet"))
    assert 0 < len(model.rules) <= MOST_RULES
    rows = [(k, t) for k, t in enumerate([*TEXTS, None])]
    got = {r["doc_id"]: r for r in assess(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        x = dict(zip(NAMES, plain(t or ""), strict=True))
        z = model.intercept + sum(w for rule, w in model.rules if all(low < x[n] <= high for n, low, high in rule.bounds))
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.5)


def test_rules_are_paths_and_lasso_is_optimal():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    w = np.ones(len(y))
    rules = tree_rules(x, y, w)
    assert len(set(rules)) == len(rules) and all(1 <= len(r.bounds) <= 3 for r in rules)
    m = np.column_stack([r.holds(x) for r in rules]).astype(float)
    b0, b = lasso(m, y, w, 0.01, 20_000)
    slope = m.T @ (1 / (1 + np.exp(-(b0 + m @ b))) - y) / len(y)
    assert np.abs(slope).max() <= 0.01 + 1e-4
    np.testing.assert_allclose(slope[b != 0], -0.01 * np.sign(b[b != 0]), atol=1e-3)
    z = fit(x, y, w)
    p = z.intercept + sum(weight * r.holds(x) for r, weight in z.rules)
    assert ((p >= 0) == (y == 1)).mean() > 0.97


def test_held_out_accuracy(spark):
    got = QUERIES["op13_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = got.where("held_out").select("quality", "predicted", "score").collect()
    assert len(held) > 1000
    for label in (0, 1):
        of = [r for r in held if r["quality"] == label]
        assert sum(r["predicted"] == label for r in of) / len(of) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(1500), spark.read.parquet(f"{SF}/labels.parquet")
    learn = docs.where("doc_id % 2 = 0")
    turned = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(learn, labels) == train(learn, turned)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text"), (None, None), (1, "good text"), (2, "!!!")], "doc_id long, text string").withColumns({"score": F.lit("x"), "letters": F.lit(1), "id": F.lit(2), "y": F.lit(3)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs, none) == RuleModel(0.0, ())
    out = assess(docs, train(docs, none))
    assert out.columns == ["doc_id", "score", "predicted"] and [(r["score"], r["predicted"]) for r in out.collect()] == [(0.5, 1)] * 4
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, 7), (5, 0)], "doc_id long, quality int")
    assert [r["score"] for r in assess(docs, train(docs, one)).collect()] == [pytest.approx(3 / 4)] * 4
    assert assess(docs.limit(0), train(docs.limit(0), one)).count() == 0


def test_a_repeated_id_is_bounded(spark):
    rng = random.Random(0)
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("words that are fine "), F.col("id").cast("string")).alias("text"))
    rest = spark.createDataFrame([(k, "&&& " * rng.randint(5, 50)) for k in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *[(k, 0) for k in range(2, 200)]], "doc_id long, quality int")
    model = train(hot.union(rest), labels, per_label=100)
    got = assess(hot.union(rest), model).groupBy("predicted").count().collect()
    assert {r["predicted"]: r["count"] for r in got} == {1: 3000, 0: 198}
