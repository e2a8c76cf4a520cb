"""Uniform sharding with exact shard sizes.

Rows fall into source partitions by a hash of their identity. How many rows each partition sends to each target is drawn
exactly: a matrix with the given row and column sums from the multivariate hypergeometric law, which is what a uniform
permutation of all rows would show. Each partition permutes its rows locally and deals them out by its row of the matrix,
the rows are exchanged, and each target permutes what it got.

The matrix is never held anywhere. It is split along a binary tree over partitions whose nodes draw with seeds of their
own, so a task derives its row from the partition sizes alone, the same at every attempt. A shard of any size is divided
into target cells of bounded, exact sizes (a uniform shuffle of a shard is a uniform choice of cells and a shuffle of
each), so no task holds a whole shard and slots follow from the cell's first slot. A partition's row of the matrix is cut into
slices of ``SLICE`` ranks, none of which meets more cells than it has ranks, so what a row costs doesn't grow with the cells.

Law: ``rows``, shard sizes differ by one row at most. Defined results: null texts have no bytes; rows with a null id or
repeated rows are dealt like others, by their place in their file, or by id and text if the rows don't come straight from Parquet files
(then rows alike in both share a partition of the exchange); an empty table gives an empty result;
columns pass through, and the added ones replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_crc32

CELL_ROWS = 4096
#: Most partitions and cells: a task draws one row of the matrix at a time, of this many entries, and the driver holds one count
#: for each partition. Beyond ``CELL_ROWS`` times as many rows cells grow.
MOST_CELLS = 1 << 16
SLICE = 64


def even_sizes(total: int, parts: int) -> np.ndarray:
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def hypergeometric(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Exact counts by colour of ``draws`` balls taken without replacement."""
    if sizes.sum() < 10**9:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    out, left = np.zeros_like(sizes), int(sizes.sum())
    for i, n in enumerate(map(int, sizes)):
        left -= n
        out[i] = _one_colour(rng, n, left, draws)
        draws -= int(out[i])
    return out


def _one_colour(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric draw of any size: two binomials, kept when they add up to the number of draws."""
    if not draws or not good or not bad:
        return min(draws, good)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    p = draws / (good + bad)
    while True:
        a, b = rng.binomial(good, p, 1 << 16), rng.binomial(bad, p, 1 << 16)
        if len(hit := np.flatnonzero(a + b == draws)):
            return int(a[hit[0]])


def matrix_row(part_sizes: np.ndarray, cell_sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix, by walking down the tree over partitions."""
    low, high, cells = 0, len(part_sizes), cell_sizes.copy()
    ends = np.concatenate([[0], np.cumsum(part_sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        left = hypergeometric(np.random.default_rng([seed, low, high]), cells, int(ends[middle] - ends[low]))
        low, high, cells = (low, middle, left) if part < middle else (middle, high, cells - left)
    return cells


def slices(stop: np.ndarray, cell: np.ndarray) -> list[list[dict]]:
    """Cells with the rank where each ends, listed for every ``SLICE`` ranks that they meet."""
    out = []
    for start in range(0, int(stop[-1]) if len(stop) else 0, SLICE):
        a, b = np.searchsorted(stop, [start, min(start + SLICE, stop[-1]) - 1], "right")
        out.append([{"stop": int(stop[i]), "cell": int(cell[i])} for i in range(a, b + 1)])
    return out


def row_identity(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: their place in a file, so that repeated rows spread like any others; where the rows aren't read from Parquet
    files as they are, their id and text."""
    try:
        place = df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return [F.col(id_col), text_crc32(F.col(text_col))]
    return [F.col(f"_metadata.{c}") for c in place.columns]


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform permutation cut into shards whose sizes differ by one row at most."""
    spark = df.sparkSession
    total = df.count()
    cell_rows = max(cell_rows, -(-total // MOST_CELLS))
    parts = max(1, -(-total // cell_rows))
    # one draw of 64 bits per row fixes its partition and its place there
    who = row_identity(df, id_col, text_col)
    keyed = df.withColumns({"_key": F.xxhash64(F.lit(seed), *who), "_part": F.pmod(F.xxhash64(F.lit(seed + 1), *who), F.lit(parts)).cast("int")}).drop("shard", "slot")
    counts = keyed.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one number per partition
    part_sizes = np.zeros(parts, np.int64)
    for r in counts:
        part_sizes[r["_part"]] = r["n"]
    shard_sizes = even_sizes(total, shards)
    per = max(1, -(-total // (shards * cell_rows)))
    cell_sizes = np.concatenate([even_sizes(int(n), per) for n in shard_sizes])
    shared = spark.sparkContext.broadcast((part_sizes, cell_sizes))
    first_slot = np.concatenate([np.cumsum(x) - x for x in cell_sizes.reshape(shards, per)])

    def deals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("stop", pa.int64()), ("cell", pa.int32())])))
        for batch in batches:
            for part in batch.column("_part").to_pylist():
                row = matrix_row(*shared.value, part, seed)
                some = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slices(np.cumsum(row)[some], some)], kind)], ["_part", "_deal"])

    # one row for each partition, with as many entries as the matrix row has above zero and one more for each slice
    deal = spark.range(parts).select(F.col("id").cast("int").alias("_part")).repartition(min(parts, 200)).mapInArrow(deals, "_part int, _deal array<array<struct<stop: long, cell: int>>>")
    local = Window.partitionBy("_part").orderBy("_key", F.col(id_col).asc_nulls_first())
    # a merge join: the window has dealt the rows by partition, and the deal grows with partitions times cells
    ranked = keyed.withColumn("_rank", F.row_number().over(local) - 1).join(deal.hint("merge"), "_part")
    near = F.element_at("_deal", (F.col("_rank") / SLICE).cast("int") + 1)
    dealt = ranked.withColumn("_cell", F.element_at(F.filter(near, lambda x: F.col("_rank") < x["stop"]), 1)["cell"]).drop("_deal", "_rank", "_part")
    again = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 2), "_key"), F.col(id_col).asc_nulls_first())
    starts = spark.createDataFrame(pd.DataFrame({"_cell": np.arange(len(cell_sizes), dtype=np.int32), "_first": first_slot}))
    out = dealt.withColumn("_place", F.row_number().over(again) - 1).join(starts, "_cell").withColumn("slot", F.col("_first") + F.col("_place"))
    return out.withColumn("shard", (F.col("_cell") / per).cast("int")).withColumn("slot", F.col("slot").cast("long")).drop("_cell", "_first", "_place", "_key")
