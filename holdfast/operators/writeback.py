"""Keyed write-back without in-place mutation: join, fill, write a new version."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_missing(target: DataFrame, source: DataFrame, key: str, columns: Mapping[str, str] | list[str], when_null: str) -> DataFrame:
    """Where ``when_null`` is NULL and the key has a source row, take the source's columns.

    ``columns`` maps target columns to source columns. The source must be unique on the key.
    """
    pairs = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    renamed = source.select(key, F.lit(True).alias("_found"), *[F.col(s).alias(f"_new_{t}") for t, s in pairs.items()])
    joined = target.join(renamed, key, "left")
    take = F.col(when_null).isNull() & F.col("_found")
    filled = {t: F.when(take, F.col(f"_new_{t}")).otherwise(F.col(t)) for t in pairs}
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in target.columns])


def replace_rows(previous: DataFrame, recomputed: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``previous`` with the rows of ``keys`` swapped for the recomputed ones."""
    return previous.join(keys.select(key), key, "left_anti").unionByName(recomputed)
