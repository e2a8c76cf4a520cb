"""How the sources of each language differ in their terms, by factoring texts into chunks.

Texts are cut at ASCII white space. Each batch counts its chunks by document and sums them to one row for each (language, source,
chunk): occurrences, documents, and the least and greatest of their row numbers. Each globally distinct chunk is cut into terms once,
and its terms are joined back to these sums. So no row of (document, chunk) is ever moved.

A term is kept if ``min_docs`` (1 to 3) documents of its language have it. A document may have a term in several chunks, so the documents of
chunks don't simply add up. But a chunk in three or more documents decides at once, and of any other the least and the greatest row number are
all its documents; distinct row numbers are counted over the chunks of a term.

For the kept terms each (language, source) and each language has p = 1 + floor(10^9 (count + 1) / (N + V)), with N the sum of its counts
and V the number of kept terms, and the divergence of p from q at a term is floor((p - q)^2 / q). All of it is integers. Sums over all kept
terms are made in cells of (terms x sources) of at most ``CELL`` entries, absent terms included, whatever the number of either.

Defined results: null text, language and source are empty strings; rows are documents, also repeated ones and such with null or equal ids;
texts without terms still make their group; an empty table gives no rows; other columns are not read. Equal values rank by their
items. Beside their terms, chunks longer than 63 bytes go by their SHA-256. Groups go by 64-bit hashes, with a seed for which no two are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, rows_of

#: Fixed: what no term holds, ASCII but for its letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_BYTES = 8 << 20
CELL = 1 << 20
#: Sources whose divergences one group of a cell computes.
SOURCES = 64
#: Row numbers of a task begin at its number times 2^33.
ROWS_BITS = 33


def group_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """The (lang, source) groups with their numbers ``lid`` and ``gid``, written, and the seed of the hash that tells all of them apart."""
    groups = materialize(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    seed = 0
    while True:
        numbered = groups.select("lang", "source", *_numbers(seed))
        n = numbered.agg(F.countDistinct("lang"), F.countDistinct("lid"), F.count("*"), F.countDistinct("gid")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return numbered, seed
        seed += 1


def _numbers(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid")]


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << ROWS_BITS
    for batch in rows_of(batches, BATCH_BYTES, "text"):
        docs = batch.num_rows
        lists = pc.ascii_split_whitespace(batch.column("text"))
        words, doc = lists.flatten(), pc.list_parent_indices(lists)
        held = pc.not_equal(words, "")
        words, doc = words.filter(held).dictionary_encode(), doc.filter(held).to_numpy().astype(np.int64)
        gids, one, group = np.unique(batch.column("gid").to_numpy(), return_index=True, return_inverse=True)
        lids = batch.column("lid").to_numpy()[one]
        chunks = max(len(words.dictionary), 1)
        seen, times = np.unique((group[doc] * chunks + words.indices.to_numpy()) * docs + doc, return_counts=True)
        if len(seen):
            key, at = seen // docs, seen % docs
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            last = np.append(first[1:], len(key)) - 1
            g, c = key[first] // chunks, key[first] % chunks
            yield pa.record_batch(
                [pa.array(lids[g]), pa.array(gids[g]), words.dictionary.take(pa.array(c)), pa.array(np.add.reduceat(times, first)), pa.array(last - first + 1), pa.array(row + at[first]), pa.array(row + at[last])],
                names=["lid", "gid", "chunk", "n", "n_docs", "least", "most"],
            )
        row += docs


def chunk_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lid, gid, chunk, n, n_docs, least, most) for each chunk of a group; ``least`` only below three documents, ``most`` only with two."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).select("text", *_numbers(seed))
    counted = texts.mapInArrow(_count_chunks, "lid long, gid long, chunk string, n long, n_docs long, least long, most long")
    sums = counted.groupBy("lid", "gid", "chunk").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.min("least").alias("least"), F.max("most").alias("most"))
    return sums.withColumns({"least": F.when(F.col("n_docs") < 3, F.col("least")), "most": F.when(F.col("n_docs") == 2, F.col("most"))})


def chunk_id() -> Column:
    """Short chunks by themselves, long ones by their digest, so that a long chunk isn't repeated beside each of its terms."""
    return F.when(F.octet_length("chunk") > 63, F.sha2(F.col("chunk").cast("binary"), 256)).otherwise(F.col("chunk"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(id, term, k): the terms of each distinct chunk and how often it holds them."""
    lower = F.translate("chunk", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # the identifier is made before the terms are dealt out, not for each of them
    cut = chunks.select("chunk").distinct().select(chunk_id().alias("id"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    return cut.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("k"))


def term_counts(docs: DataFrame, min_docs: int = 3, seed: int = 0) -> DataFrame:
    """(lid, gid, term, n, n_lang) of the kept terms, written: occurrences in the group and in the language."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1, 2 or 3")
    chunks = materialize(chunk_counts(docs, seed), "chunks", "zstd")
    # partitions are sized, so the terms of one fit in a hash table; no sort of all counts
    found = chunks.withColumn("id", chunk_id()).join(chunk_terms(chunks).hint("shuffle_hash"), "id").select("lid", "gid", "term", (F.col("n") * F.col("k")).alias("n"), "n_docs", "least", "most")
    # one exchange serves all that follows; a term of a language has a row for each chunk and source at most
    dealt = found.repartition("lid", "term")
    of_term = Window.partitionBy("lid", "term")
    known = dealt.withColumns({"n_lang": F.sum("n").over(of_term), "docs": F.max("n_docs").over(of_term), "low": F.min("least").over(of_term), "high": F.max(F.coalesce("most", "least")).over(of_term)})
    other = lambda c: (F.col(c) != F.col("low")) & (F.col(c) != F.col("high"))
    enough = (F.col("docs") >= min_docs) | (F.col("low") < F.col("high"))
    if min_docs == 3:
        enough = (F.col("docs") >= 3) | F.max(other("least") | other("most")).over(of_term)
    kept = known.withColumn("enough", enough).where("enough")
    counts = materialize(kept.groupBy("lid", "gid", "term").agg(F.sum("n").alias("n"), F.max("n_lang").alias("n_lang")), "kept")
    forget(chunks)
    return counts


def share(count: Column, total: Column, terms: Column) -> Column:
    whole = F.lit(10**9).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, (total + terms).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cell(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the cell's terms of the divergence of each source of one block from every source of the language."""
    if not counts.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("lid", "place", "other", "value")})
    lang, _, block = (x.as_py() for x in key)
    none = np.empty(sources.num_rows, np.int64)
    none[sources["place"].to_numpy()] = sources["absent"].to_numpy()
    terms = counts["term"].combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    p = np.repeat(none[:, None], len(terms.dictionary), axis=1)
    p[counts["place"].to_numpy(), terms.indices.to_numpy()] = counts["p"].to_numpy()
    mine = np.arange(block * SOURCES, min((block + 1) * SOURCES, len(none)))
    value = np.concatenate([((p[a] - p) ** 2 // p).sum(axis=1) for a in mine])
    place, other = np.repeat(mine, len(none)), np.tile(np.arange(len(none)), len(mine))
    keep = place != other
    return pa.table({"lid": pa.array(np.full(int(keep.sum()), lang)), "place": pa.array(place[keep], pa.int64()), "other": pa.array(other[keep], pa.int64()), "value": pa.array(value[keep], pa.int64())})


def audit(docs: DataFrame, min_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` ranks the other sources of the language by divergence, ``term`` the terms that a source has more of."""
    named, seed = group_keys(docs)
    counts = term_counts(docs, min_docs, seed)
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    # every group that has a term has its count in the language
    langs = counts.groupBy("lid", "term").agg(F.max("n_lang").alias("n_lang")).groupBy("lid").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = named.join(totals, "gid", "left").join(langs, "lid", "left").fillna(0, ["total", "total_lang", "terms"])
    by_lang = Window.partitionBy("lid")
    # one row a group, so a window over those of a language is small
    groups = groups.withColumns({"place": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long"), "sources": F.count("*").over(by_lang), "absent": F.when(F.col("total") + F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))})
    groups = materialize(groups, "groups")

    shares = counts.join(groups.select("gid", "place", "sources", "total", "terms", "total_lang"), "gid").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    keys = ["lid", "cell", "block"]
    cells = F.ceil(F.col("terms") * F.col("sources") / CELL)
    blocks = F.explode(F.sequence(zero, F.floor((F.col("sources") - 1) / SOURCES))).alias("block")
    left = shares.where("sources > 1").select("lid", F.pmod(F.xxhash64("term"), cells).alias("cell"), "place", "term", "p", blocks)
    right = groups.where("sources > 1 AND terms > 0").select("lid", "place", "absent", "sources", F.explode(F.sequence(zero, cells - 1)).alias("cell")).select("lid", "cell", "place", "absent", blocks)
    # new names for the columns of the right side, as both sides come from the same table
    right = right.toDF("lid_", "cell_", "place", "absent", "block_")
    sums = left.groupBy(*keys).cogroup(right.groupBy("lid_", "cell_", "block_")).applyInArrow(_cell, "lid long, place long, other long, value long")
    sums = sums.groupBy("lid", "place", "other").agg(F.sum("value").alias("value"))
    own, others = groups.select("lid", "place", "lang", "source"), groups.select("lid", F.col("place").alias("other"), F.col("source").alias("item"))
    pairs = sums.join(own, ["lid", "place"]).join(others, ["lid", "other"]).select("lang", "source", "item", "value")
    without = groups.where("terms = 0")
    same = without.select("lang", "source").join(without.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", zero)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.unionByName(same).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    p, q = F.col("p"), F.col("q")
    terms = shares.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))).where(p > q).select("gid", F.col("term").alias("item"), divergence(p, q).alias("value"))
    best = terms.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)
    return pairs.unionByName(best.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
