"""What the operators of this package share: table reading, shared scratch tables, small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.scratch = path
    return held


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialize``, in buckets of ``key``, so that joins on it move only the other side. For keys without hot values."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    held = spark.table(name)
    held.scratch, held.catalog_name = path, name
    return held


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` or ``materialize_by`` wrote, once everything made from them is written itself."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "catalog_name"):
            spark.sql(f"DROP TABLE {t.catalog_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def rows_of(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the given text column holds about ``max_bytes`` in each; one long row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.coalesce(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)

