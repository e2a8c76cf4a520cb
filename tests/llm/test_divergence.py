"""Source divergence against a plain computation with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import divergence
from orrery.llm.divergence import audit, group_keys, term_counts

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def kept_counts(rows, min_docs=3):
    docs, counts = defaultdict(set), defaultdict(Counter)
    for i, (_, text, lang, source) in enumerate(rows):
        counts[lang or "", source or ""].update(terms_of(text))
        for t in terms_of(text):
            docs[lang or "", t].add(i)
    kept = defaultdict(set)
    for (lang, t), who in docs.items():
        if len(who) >= min_docs:
            kept[lang].add(t)
    return kept, counts


def brute(rows):
    kept, counts = kept_counts(rows)
    out = []

    def shares(count, lang):
        n, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // (n + v) for t in kept[lang]}

    groups = sorted(counts)
    for lang, source in groups:
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        p, q = shares(counts[lang, source], lang), shares(whole, lang)
        others = {s: shares(counts[lang, s], lang) for x, s in groups if x == lang and s != source}
        pair = {s: sum((p[t] - o[t]) ** 2 // o[t] for t in p) for s, o in others.items()}
        term = {t: (p[t] - q[t]) ** 2 // q[t] for t in p if counts[lang, source][t] and p[t] > q[t]}
        for part, found, most in (("pair", pair, None), ("term", term, 200)):
            ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, v, r + 1) for r, (item, v) in enumerate(ranked)]
    return sorted(out)


def made(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(rng, n, sources):
    words = ["Ab", "ab", "ab,", "(ab)", "x-y", "é", "É", "123", "don't", "a b", "a ", "\x1cq", "...", "日本", "x" * 70 + "-x", "z"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20)]
    return [(rng.choice([None, 1, i]), rng.choice([None, "", *[" ".join(rng.choice(words) + rng.choice(["", "\n", "."]) for _ in range(rng.randint(0, 30)))] * 8]), rng.choice([None, "", "en", "en", "en", "de"]), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_integers(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, 400, [None, "", "a", "b", "hot", "hot", "hot"])
    rows += [rows[0]] * 3 + [(9, "once only", "rare", "a"), (9, "2 + 2", "rare", "b"), (9, None, "alone", "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert made(audit(df)) == brute(rows)


def test_many_sources_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELL", 500)  # read when the plan is made
    rows = corpus(random.Random(3), 900, [f"s{k}" for k in range(150)])
    assert made(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_kept_terms(spark, min_docs):
    rows = corpus(random.Random(4), 60, ["a", "b"])
    kept, counts = kept_counts(rows, min_docs)
    want = sorted((lang, s, t, n) for (lang, s), c in counts.items() for t, n in c.items() if t in kept[lang])
    df = spark.createDataFrame(rows, SCHEMA)
    names, seed = group_keys(df)
    got = term_counts(df, min_docs, seed).join(names, ["lid", "gid"])
    assert sorted(tuple(r) for r in got.select("lang", "source", "term", "n").collect()) == want


def test_odd_tables(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = [(1, "a a a", "en", "x"), (2, "", "en", "y"), (3, None, "en", None)]
    clash = spark.createDataFrame(lone, SCHEMA).withColumns({"term": F.lit(1), "n": F.lit(2), "place": F.lit(3), "value": F.lit("v")})
    assert made(audit(clash)) == brute(lone) and len(brute(lone)) == 6
    with pytest.raises(ValueError):
        term_counts(clash, 4)


def test_very_long_texts(spark):
    rows = [(k, "long " * 500_000 + "x" * 3_000_000 + " " + "a-" * 200_000, "en", "s" + str(k % 2)) for k in range(4)]
    assert made(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
