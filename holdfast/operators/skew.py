"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot when it holds more than 1/SHARE of the rows, so there are fewer than SHARE of them.
SHARE = 1024
# Keys below this many rows are never worth splitting.
MIN_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, share: int = SHARE, min_rows: int = MIN_ROWS) -> list[tuple]:
    """[(key, parts)]: the hot keys and into how many parts each should fall; a NULL key may be among them.

    One pass with a frequent-items sketch: no shuffle by key, and by counting at most
    ``share`` entries come back. The counts are estimates; they steer the balance of a
    join and never its result.
    """
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("nulls"),
        F.expr(f"approx_top_k({key}, {share}, {share * 16})").alias("top"),
    ).first()
    limit = max(found["rows"] / share, min_rows)
    sizes = [(r["item"], r["count"]) for r in found["top"] or [] if r["item"] is not None]
    sizes.append((None, found["nulls"]))
    return [(item, min(share, math.ceil(n / limit))) for item, n in sizes if n > limit]


def join_to_unique(
    rows: DataFrame,
    unique: DataFrame,
    key: str,
    row_id: Sequence[str],
    how: str = "left",
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Join ``rows`` to a side that holds each key at most once.

    Without hot keys this is a plain join. Otherwise the rows of a hot key are spread by
    ``row_id`` over several parts and the single partner row is repeated for each part,
    so no task receives much more than 1/``share`` of the rows.
    """
    hot = hot_keys(rows, key, share, min_rows)
    if not hot:
        return rows.join(unique, key, how)
    schema = T.StructType([T.StructField("_hot", rows.schema[key].dataType), T.StructField("_parts", T.IntegerType())])
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, schema))  # at most ``share`` rows
    split = F.pmod(F.xxhash64(*row_id), F.coalesce("_parts", F.lit(1))).cast("int")
    spread = rows.join(parts, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_part", split).drop("_hot", "_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = unique.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_part", copies).drop("_hot", "_parts")
    return spread.join(repeated, [key, "_part"], how).drop("_part")
