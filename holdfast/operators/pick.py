"""Choosing rows per key: latest, best, last n, and whole groups as bounded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.ids import dense_numbers
from holdfast.operators.skew import join_to_unique
from holdfast.sources.workspace import written_keys


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (give a full tie-break).

    Spark cuts every key to ``n`` rows before the shuffle (WindowGroupLimit), so a hot
    key sends at most ``n`` rows per map task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def best_fields(df: DataFrame, keys: Sequence[str], order_fields: Sequence[str], fields: Sequence[str], latest: bool) -> DataFrame:
    """One row per key with the fields of its smallest (or largest) ``order_fields`` row.

    A plain aggregate: each map task keeps one candidate per key.
    """
    names = list(dict.fromkeys([*order_fields, *fields]))
    packed = F.struct(*names)
    chosen = (F.max(packed) if latest else F.min(packed)).alias("_best")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_best.{f}").alias(f) for f in fields])


def last_n_array(df: DataFrame, key: str, order: Sequence[Column], item: Column, n: int, name: str) -> DataFrame:
    """One array per key with its first ``n`` rows in ``order``."""
    top = top_per_key(df, [key], order, n, rank="_rank")
    packed = F.sort_array(F.collect_list(F.struct(F.col("_rank"), item.alias("item"))))
    return top.groupBy(key).agg(F.transform(packed, lambda p: p["item"]).alias(name))


def one_per_key(df: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Each key once: of rows that share it the smallest in the order of the columns.

    Only keys that repeat are gathered, with partial minima; all other rows pass as they are. The repeated keys are written
    first, so that a few of them are broadcast and no row moves. ``keys``: the keys of the rows, as often as they occur, where reading
    them from the rows costs more.
    """
    others = [c for c in df.columns if c != key]
    repeated = written_keys((df if keys is None else keys).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key))
    least = df.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return df.join(repeated, key, "left_anti").unionByName(least.select(key, "_row.*").select(*df.columns))


def group_arrays(
    df: DataFrame,
    key: str,
    row_id: str,
    order_fields: Sequence[str],
    item: Column,
    name: str,
    limit: int = 10_000,
) -> DataFrame:
    """All rows of each key as sorted arrays of at most ``limit`` items: ``(key, chunk, <name>)``.

    Rows are numbered over sorted range partitions; chunk 0 has the first ``limit`` rows of the
    key, chunk 1 the next, and so on. No array or task holds an unbounded group, whatever its size.
    """
    order = [key, *order_fields, row_id]
    numbered = dense_numbers(df.withColumn("_item", item), order, "_number")
    firsts = numbered.groupBy(key).agg(F.min("_number").alias("_first"))
    placed = join_to_unique(numbered, firsts, key, [row_id], "inner")
    placed = placed.withColumn("chunk", F.floor((F.col("_number") - F.col("_first")) / limit).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct("_number", "_item")))
    return placed.groupBy(key, "chunk").agg(F.transform(packed, lambda p: p["_item"]).alias(name))
