"""Dense numbering of a distributed result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.columns import id_number, numbered_id
from holdfast.sources.workspace import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def dense_numbers(df: DataFrame, order: Sequence[str | Column], name: str, start: int | Column = 0) -> DataFrame:
    """``name`` = start + 1, start + 2, ... in the global ``order`` (give a unique order).

    Range partitions are sorted in parallel and numbered locally; the result is written
    to the checkpoint folder once, so the numbers cannot change when an executor is
    lost. Only one count per partition is put in order on a single task.
    """
    local = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = checkpointed(local).withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS))
    counts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: its size is the shuffle partition count, whatever the data.
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + (F.col("_at") % F.lit(1 << _ROW_BITS)) + 1
    start = F.lit(start) if isinstance(start, int) else start
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (number + start).cast("bigint"))
        .drop("_at", "_part", "_offset")
    )


def with_ids(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    prefix: str,
    start: int | Column = 0,
) -> DataFrame:
    """Dense numbers printed as ids such as ``NBA00001``."""
    numbered = dense_numbers(df, order, "_number", start)
    return numbered.withColumn(name, numbered_id(prefix, F.col("_number"))).drop("_number")


def highest_number(df: DataFrame, name: str, prefix: str) -> Column:
    """Scalar subquery: the largest number used in an id column, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(id_number(name, prefix)), F.lit(0)).alias("highest")).scalar()
