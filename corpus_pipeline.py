"""A training corpus in four stages: known language, one of each group of near copies, no benchmark items, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows are told apart by id and text, so null or repeated ids are no
trouble; rows alike in both are one document.

- ``language``: texts without a letter go, and so do texts of ``LEAST_SYMBOLS`` letters, non-ASCII bytes and gaps or more that the
  network takes for junk (key mashing, digests, a script that no labelled text has) with a probability of ``MOST_JUNK`` or more beside
  all languages. Shorter texts stay, as a few letters tell nothing. The network learns from a bounded sample of the stage's own
  labelled rows; if there are none, only letterless texts go.
- ``near_copies``: of documents linked at 0.8 similarity of five-word shingles the one with the least id stays. Texts without
  words link with nothing and stay.
- ``benchmark``: documents that hold a test item go.
- ``packed``: the remaining documents as pieces in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialize, table
from orrery.llm.decontaminate import contaminated
from orrery.llm.language import identify, train
from orrery.llm.ngram_join import similarity_components
from orrery.llm.packing import pack
from orrery.llm.queries import tokenizer_file

MOST_JUNK = 0.95
LEAST_SYMBOLS = 32


def row_key() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = train(docs, junk=True)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # the network's columns are told from those of the documents by taking only the text along with a row's own columns as one
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    junk = (F.col("junk") >= MOST_JUNK) & (F.col("n_symbols") >= LEAST_SYMBOLS)
    return identify(held, net).where((F.col("lang_pred") != "und") & ~junk).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = similarity_components(docs.select(row_key().alias("row"), "text"), size=5, percent=80, id_col="row")
    kept = materialize(groups.where(F.col("row") == F.col("component_id")).groupBy("row").agg(F.count("*").alias("n")), "kept")
    keyed = docs.withColumn("_row", row_key())
    those = lambda rows: keyed.join(rows, keyed["_row"].eqNullSafe(rows["row"]), "left_semi")
    stays = those(kept.where("n = 1")).drop("_row")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        # rows alike in id and text are one document; only texts of such rows are grouped
        one = those(repeated).groupBy("_row").agg(*[F.first(c).alias(c) for c in docs.columns])
        stays = stays.unionByName(one.drop("_row"))
    return stays.select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_row", row_key())
    leaks = materialize(contaminated(keyed.select("_row", "text"), table(spark, sf_dir, "benchmark"), id_col="_row"), "leaks")
    return keyed.join(leaks, "_row", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("packed", packed)]

#: SQL can't express the network or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
