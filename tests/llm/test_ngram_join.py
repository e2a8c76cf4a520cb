"""Components of the similarity join against all pairs."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from orrery.llm import ngram_join
from orrery.llm.ngram_join import components, shingle_sets, similarity_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def by_hand(rows, percent=90, size=3):
    """Union-find over all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    distinct, holders = defaultdict(list), defaultdict(list)
    for i, s in enumerate(sets):
        distinct[frozenset(s)].append(i)
    heads = [v[0] for k, v in distinct.items() if k]
    for k, v in distinct.items():
        for i in v[1:] if k else []:
            parent[find(i)] = find(v[0])
    for i in heads:
        shared = defaultdict(int)
        for x in sets[i]:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = doc if least[r] is None else min(least[r], doc)
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def compare(spark, rows, percent=90, size=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(df, size, percent).collect()), key=str)
    assert got == by_hand(rows, percent, size)
    return got


def test_shingle_sets():
    texts = ["", " ", "One", "one  two", "a b c", "A b\tC d a b c", "é È x y", "x" * 5000 + " y z w"]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts], 3), strict=True):
        assert len(s) == len(shingles(t)) and (np.diff(s.astype(object)) > 0).all()
    a, b = shingle_sets([b"One TWO three", b"one two  three\n"], 3)
    assert (a == b).all()


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_near_copies(spark, monkeypatch, seed):
    """Near copies at all distances around the threshold, large groups, shared passages, short and odd texts."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    monkeypatch.setattr(ngram_join, "FREQUENT", [24, 4, 2][seed])
    if seed == 2:  # bitmaps too small for the data: shingles that occur a few times are indexed like rare ones
        monkeypatch.setattr(ngram_join, "RARE_BITS", [12])
        monkeypatch.setattr(ngram_join, "FREQUENT_BITS", 12)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    texts = [None, "", " ", "a", "a", "a b", "A B", "a b c", "a b c d", "b c d"]
    passage = " ".join(word() for _ in range(60))
    for size, copies, edits in ((140, 150, 9), (400, 60, 25), (30, 40, 2), (12, 20, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = base[:]
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(at, word()), lambda: w.insert(at, word()), lambda: w.pop(at)])()
            texts.append(" ".join(w))
    for _ in range(60):
        texts.append(" ".join([*[word() for _ in range(rng.randint(0, 9))], passage, *[word() for _ in range(rng.randint(0, 9))]]))
    texts += rng.choices(texts, k=80)
    rows = [(i if i % 37 else None, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = compare(spark, rows, *[(90, 3), (80, 5), (90, 3)][seed])
    assert len({c for _, _, c in got}) < len(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows)


def test_empty(spark):
    assert similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(10_000), 60)
    edges = list(zip(nodes[:30], nodes[1:30], strict=False)) + list(zip(nodes[30:], nodes[31:], strict=False)) + [e for e in combinations(nodes[:5], 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: min(nodes[:30] if n in nodes[:30] else nodes[30:]) for n in nodes}
