"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, shared_dir, table, text_crc32


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"), id_fold(F.col("doc_id"), 10) != 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shuffle import uniform_shards

    out = uniform_shards(table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return out.select("doc_id", size.alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licences

    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = id_fold(F.col("doc_id"), 3) == 1
    net = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    # a lasting cache where the session names one; else this run's own
    cache = spark.conf.get("spark.orrery.tokenCache", None) or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, record_fields, write_archive

    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return record_fields(read_archive(spark, path))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import sequences, share_heads, trie

    return trie(share_heads(sequences(table(spark, sf_dir, "conversations"))))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess, train

    docs = table(spark, sf_dir, "documents")
    held_out = id_fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return assess(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_vector_search, op4_license_scan, op5_language_id, op6_token_counts, op7_decontamination, op8_warc_archive, op9_ngram_join, op10_packing, op11_prefix_trie, op12_divergence_audit, op13_quality_rules)}
