"""Search over catalog items, and word or line differences of text pairs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# Ranking of match types and of item types.
MATCH_ORDER = ["collection", "folder", "request", "url", "path"]
TYPE_ORDER = ["collection", "folder", "request"]
FIELDS = ["name", "url", "path"]
GRAM = 3


def normalized(query: Column) -> Column:
    return F.regexp_replace(F.trim(query), "/+", "/")


def valid(query: Column) -> Column:
    """Not empty, not a lone slash, not a single symbol."""
    q = normalized(query)
    return (q != "") & (q != "/") & ~((F.length(q) == 1) & ~q.rlike("[a-zA-Z0-9]"))


def terms_of(query: Column) -> Column:
    return F.filter(F.split(F.lower(normalized(query)), r"[\s/]+"), lambda t: t != "")


def grams(text: Column, size: int) -> Column:
    """Stretches of ``size`` characters of a text, one from each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _match(lower: dict[str, Column], terms: Column, kind: Column, by_path: Column) -> Column:
    has = lambda c: F.forall(terms, lambda t: F.contains(lower[c], t))
    return F.when(has("name"), kind).when((kind == "request") & has("url"), "url").when((kind != "collection") & by_path & has("path"), "path")


def postings(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, field, uid) of the ``wanted`` grams (gram, size) in the lower-case fields of the items: an inverted index, written."""
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]  # of 1, 2, 3
    fields = [F.struct(F.lit(c).alias("field"), F.lower(F.coalesce(c, F.lit(""))).alias("text")) for c in FIELDS]
    texts = items.select("uid", F.explode(F.array(*fields)).alias("f")).select("uid", "f.field", "f.text")
    none = F.array().cast("array<string>")
    held = texts.select("uid", "field", F.explode(F.concat(none, *[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    return written(held.join(wanted.select("gram"), "gram", "left_semi"), "postings")


def search(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, uid, type, name, match_type) of every item that holds all terms of a query in its name, URL or full path.

    ``items``: uid, type, name, url, path. By an inverted index of trigrams: a field that holds all terms holds all their trigrams, so a query
    meets only the postings of the rarest of them, and each item found is then compared with the terms themselves. A query whose terms all
    have one or two letters takes grams of that length. Paths count only for queries with a slash.
    """
    asked = queries.where(valid(F.col("query"))).select("query_id", terms_of(F.col("query")).alias("terms"), F.contains(normalized(F.col("query")), F.lit("/")).alias("by_path")).where(F.size("terms") > 0)
    longest = F.array_max(F.transform("terms", lambda t: F.length(t)))
    asked = written(asked.withColumn("size", F.least(F.lit(GRAM), longest)), "asked")
    of_size = reduce(lambda c, n: c.when(F.col("size") == n, F.flatten(F.transform("terms", lambda t: grams(t, n)))), range(1, GRAM + 1), F)
    parts = asked.select("query_id", "by_path", "size", F.explode(of_size).alias("gram")).distinct()
    # read twice, for the index and for the comparison; dealt evenly, as a row makes some hundred grams
    items = written(items.select("uid", "type", *FIELDS).repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid"), "items")
    index = postings(items, parts.select("gram", "size").distinct())
    often = parts.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").fillna(0, ["n"])
    rarest = often.groupBy("query_id", "by_path").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    near = rarest.join(index, "gram").where((F.col("field") != "path") | F.col("by_path")).select("query_id", "uid").distinct()
    kind = F.when(F.col("type").isin("collection", "folder"), F.col("type")).otherwise("request")
    lower = {c: F.lower(F.coalesce(c, F.lit(""))) for c in FIELDS}
    met = near.join(items, "uid").join(asked.drop("size"), "query_id")
    return met.withColumn("match_type", _match(lower, F.col("terms"), kind, F.col("by_path"))).where("match_type is not null").select("query_id", "uid", kind.alias("type"), "name", "match_type")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` hits of each query: match type, item type, name."""
    place = lambda c, order: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    order = Window.partitionBy("query_id").orderBy(place("match_type", MATCH_ORDER), place("type", TYPE_ORDER), F.lower("name"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# Separators, each a token of its own; words are what stands between them.
WORDS = re.compile(r"[\s/?&=.\-_:@]|[^\s/?&=.\-_:@]+")

# Fixed value: rows whose differences are Python objects at a time.
DIFFS_AT_ONCE = 50


def segments(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Runs of unchanged, deleted and added tokens by a longest common subsequence; equal ends are set aside first.

    One rule at any length: equal tokens are kept, else the old one is deleted if what follows it has as much in common, else the new one added.
    """
    start = 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    stop = 0
    while stop < min(len(old), len(new)) - start and old[-1 - stop] == new[-1 - stop]:
        stop += 1
    middle = _common(old[start : len(old) - stop], new[start : len(new) - stop])
    out: list[list] = []
    for status, token in [("unchanged", x) for x in old[:start]] + middle + [("unchanged", x) for x in old[len(old) - stop :]]:
        if out and out[-1][0] == status:
            out[-1][1].append(token)
        else:
            out.append([status, [token]])
    return [("".join(tokens), status) for status, tokens in out]


def _below(row: int, places: dict[str, int], token: str, full: int) -> int:
    """The table's row for one more token in front: bits of a number, unset where a longer rest of the other text has one more in common."""
    hit = row & places.get(token, 0)
    return ((row + hit) | (row - hit)) & full


def _common(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The walk through the table of common lengths of all rests of ``a`` and ``b``.

    A row of the table is a number of as many bits as ``b`` has tokens. Every s-th row is kept, s being the root of the number of rows, and the
    rows between are made again when the walk comes there, so memory is 2 s rows: some 8 MB for two texts of 100,000 tokens.
    """
    n, m = len(a), len(b)
    full, step = (1 << m) - 1, max(1, int(n**0.5))
    places: dict[str, int] = {}
    for j, x in enumerate(reversed(b)):  # bit k stands for the token with k behind it
        places[x] = places.get(x, 0) | 1 << j
    row, kept = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = _below(row, places, a[i], full)
        if i % step == 0:
            kept[i] = row
    near: dict[int, int] = {}
    out: list[tuple[str, str]] = []
    i = j = 0
    while i < n and j < m:
        if i not in near or i + 1 not in near:
            last = min(n, (i // step + 1) * step)
            near = {last: kept[last]}
            for k in range(last - 1, i - 1, -1):
                near[k] = _below(near[k + 1], places, a[k], full)
        # what the rests have in common with and without a's next token
        rest = (1 << (m - j)) - 1
        here, without = ((m - j) - (near[k] & rest).bit_count() for k in (i, i + 1))
        while j < m and a[i] != b[j] and here != without:
            bit = m - 1 - j
            here, without = here - (1 - (near[i] >> bit & 1)), without - (1 - (near[i + 1] >> bit & 1))
            out.append(("added", b[j]))
            j += 1
        if j == m:
            break
        if a[i] == b[j]:
            out.append(("unchanged", a[i]))
            j += 1
        else:
            out.append(("deleted", a[i]))
        i += 1
    return out + [("deleted", x) for x in a[i:]] + [("added", x) for x in b[j:]]


def differences(old: pa.Array, new: pa.Array, cut: Callable[[str], list[str]]) -> pa.Array:
    """Lists of (text, status) of each pair; few rows at a time are Python objects, which take some ten times what Arrow takes."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("status", pa.string())]))
    parts = [pa.array([], kind)]
    for at in range(0, len(old), DIFFS_AT_ONCE):
        pairs = zip(old.slice(at, DIFFS_AT_ONCE).to_pylist(), new.slice(at, DIFFS_AT_ONCE).to_pylist(), strict=True)
        parts.append(pa.array([[{"text": t, "status": s} for t, s in segments(cut(x or ""), cut(y or ""))] for x, y in pairs], kind))
    return pa.concat_arrays(parts)


def text_diff(old: Column, new: Column, lines: bool = False) -> Column:
    """Array of (text, status) between two texts, by words or lines. Equal texts skip the helper's table."""
    cut = (lambda t: t.splitlines(keepends=True)) if lines else WORDS.findall

    @F.arrow_udf("array<struct<text:string,status:string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return differences(a, b, cut)

    return F.when(old.eqNullSafe(new), F.array(F.struct(F.coalesce(old, F.lit("")).alias("text"), F.lit("unchanged").alias("status")))).otherwise(run(old, new))
