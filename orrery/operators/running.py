"""Running numbers, sums and last values under keys of any size.

A window over a key is one task for the key, however many rows it has. Here rows are sorted by range over key and order, so a large key is
cut into cells, one a partition; windows run inside the cells, and each cell is told what the cells of its key before it add up to. Only
keys that lie in several cells need to be told anything: at most two a cell, so that table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CELL = "_cell"


def cells(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in order of keys and ``order``, with the number of its range, written once."""
    return written(df.repartitionByRange(*keys, *order).withColumn(CELL, F.spark_partition_id()), "cells")


def number() -> tuple[str, Column]:
    """The row's number in its key, from 1."""
    return "sum", F.lit(1).cast("long")


def total(value: Column) -> tuple[str, Column]:
    """The sum of values up to the row."""
    return "sum", value


def most(value: Column) -> tuple[str, Column]:
    """The greatest value up to the row."""
    return "max", value


def last(value: Column) -> tuple[str, Column]:
    """The last value that isn't null up to the row."""
    return "last", value


def running(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]], itself: bool = True) -> DataFrame:
    """``df`` with the ``wanted`` running values over ascending ``order`` within ``keys``; with ``itself`` false they end before the row.

    Null keys are a key like others, nulls in ``order`` come first, and rows equal in keys and order stand in any order.
    """
    held = cells(df.withColumns({f"_{name}": value for name, (_, value) in wanted.items()}), keys, order)
    place = F.struct(*order)
    in_cell = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    so_far = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    of_cells = held.groupBy(*keys, CELL).agg(*[in_cell[kind](F.col(f"_{name}")).alias(f"_{name}") for name, (kind, _) in wanted.items()])
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    told = of_cells.withColumn("_cells", F.count("*").over(of_key)).withColumns({f"_before_{name}": so_far[kind](F.col(f"_{name}"), earlier) for name, (kind, _) in wanted.items()})
    told = told.where("_cells > 1").select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(CELL).alias("_of_cell"), *[f"_before_{name}" for name in wanted])
    here = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if itself else -1)
    local = held.withColumns({f"_{name}": so_far[kind](F.col(f"_{name}"), here) for name, (kind, _) in wanted.items()})
    same = F.col(CELL) == F.col("_of_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = local.join(F.broadcast(told), same, "left")
    join = {"sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b)}
    return joined.select(*[c for c in df.columns if c not in wanted], *[join[kind](F.col(f"_{name}"), F.col(f"_before_{name}")).alias(name) for name, (kind, _) in wanted.items()])
