"""The trie of conversation prefixes against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm.prefix_trie import sequences, share_heads, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        rows.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(1 for x in under if len(x) == len(node) + 1), sum(x not in parents for x in under),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node)).encode()).hexdigest(),
        ))
    return sorted(rows)


def made(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_turns", [1, 7, 40, 500_000])
def test_trie_equals_brute_force(spark, block_turns):
    rng = random.Random(block_turns)
    rows = []
    for c in range(-20, 100):
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, k, k, k]), rng.choice(["user", "user", None]), rng.choice(["", "a", "é", None, "long " * 5])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert made(trie(share_heads(sequences(df)), block_turns)) == brute(rebuilt(rows))


def test_copies_and_long_conversations_over_many_blocks(spark):
    copies = {c: [("user", f"t{k}") for k in range(4)] for c in range(300)}
    copies |= {c: [("user", f"t{k}") for k in range(3)] + [("user", str(c))] for c in range(300, 340)}
    copies |= {c: [("user", "t0")] + [("user", "x")] * 120 for c in range(340, 346)}
    rows = [(c, k, *t) for c, turns in copies.items() for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(trie(sequences(df), 50)) == brute(copies)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie(share_heads(sequences(empty))).count() == 0
    assert trie(sequences(spark.createDataFrame([(None, 0, "user", "a")], SCHEMA))).count() == 0
    # every conversation turnless: the root is a leaf
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    rows = [(c, 0, "user", "a") for c in h if h[c] > 0]
    got = made(trie(share_heads(sequences(spark.createDataFrame(rows, SCHEMA)))))
    ids = ",".join(str(c) for c, _, _, _ in rows)
    assert got == [(min(r[0] for r in rows), 0, None, len(rows), 0, 1, 0, hashlib.sha256(ids.encode()).hexdigest())]
    # other columns, also of the names used inside, and repeated rows
    twice = spark.createDataFrame([(7, 0, "user", "a"), (7, 0, "user", "a")], SCHEMA).withColumns({"digest": F.lit(1), "key": F.lit(2), "block": F.lit(3)})
    assert made(trie(sequences(twice))) == brute({7: [("user", "a"), ("user", "a")]})


def test_very_long_text(spark):
    long = spark.createDataFrame([(1, 0, "user", "é" * 3_000_000), (2, 0, "user", "é" * 3_000_000)], SCHEMA)
    assert made(trie(sequences(long)))[-1][6] == 6_000_000
