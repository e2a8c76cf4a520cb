"""Token counts with a digest cache.

Texts are keyed by the digest of their normalised content and by the digest of the tokenizer file. Counts already in the
cache are joined; only distinct texts that miss are encoded, and their counts are appended to the cache, a Parquet table
in the shared folder.

Normalisation here is what cannot change a count: null becomes the empty text. The tokenizer does its own (Unicode form,
white space, case) and finds its special strings before that, so anything more would alter results.

A text is encoded in parts cut at single spaces: the tokenizer's pattern keeps white space out of every token, its
normalizer turns white space runs into one space, and special strings hold no space, so the counts of the parts add up to
the count of the text. Parts recur, so each worker keeps a bounded dictionary of their counts.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are returned as often as they come; an empty
table gives an empty result; other columns pass through unread. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Most parts that a worker's dictionary holds before it starts anew.
CACHE_PARTS = 400_000
BATCH_BYTES = 8 << 20


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def part_counter(path: str):
    """A function from a list of texts to their token counts, exact for tokenizers that drop white space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        if len(known) > CACHE_PARTS:
            known.clear()
        split = [t.split(" ") for t in texts]
        missing = list(set().union(*split) - known.keys())
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, parts)) for parts in split]

    return count


def encode_counts(distinct: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in rows_of(batches, BATCH_BYTES, "text"):
            count = count or part_counter(path)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return distinct.mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; misses are appended to ``cache_path``.

    Copies of one text may be a large part of all rows:
    they meet in one encoding through map-side aggregation, and the join back is a sort-merge join that Spark splits.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn("_digest", F.unhex(F.sha2(content.cast("binary"), 256)))
    schema = "digest binary, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    cached = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == version)
    distinct = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first(content).alias("text"))
    misses = distinct.join(cached.select("digest"), "digest", "left_anti")
    encode_counts(misses, tokenizer_path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == version)
    # two runs that miss the same text at the same time append it twice
    counts = counts.groupBy(F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens"))
    out = keyed.withColumn("n_bytes", F.octet_length(content).cast("long"))
    return out.hint("merge").join(counts, "_digest").drop("_digest").withColumn("over_limit", F.col("n_tokens") > limit)
