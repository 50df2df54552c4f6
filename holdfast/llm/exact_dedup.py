"""Exact duplicates by two passes over a Bloom filter.

The first pass over the hashes marks filter positions met once and met again. The second pass
tests each hash: rows whose hash can't have been met again pass straight through, and only the
others shuffle to be grouped. A false positive merely shuffles a row more.

Cases: a null text is the empty text; empty texts equal each other; a null id is smaller than any other;
rows repeated as a whole are one group like any equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm import repeat_filter
from holdfast.llm.common import id_and_text, stored, tidy, utf8
from holdfast.operators.skew import join_to_unique

# From so many rows with one hash on, they are spread over several tasks.
SPLIT_FROM = 1_000


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(t.lower()).hexdigest() for t in utf8(batch.column(1))]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["doc_id", "text_sha256"])


def text_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row; the text is lower-cased in A-Z only."""
    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(_hash_texts), "doc_id bigint, text_sha256 string")


def _first_64_bits(digest: Column) -> Column:
    """The leading 16 hexadecimal digits as a signed number."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _maybe_repeated(digest: Column, seen: repeat_filter.HashFilter) -> Column:
    @F.arrow_udf("boolean")  # pandas, once imported, would stay in the worker
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(seen.test(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return test(_first_64_bits(digest))


def _filter_and_groups(hashes: DataFrame) -> tuple[repeat_filter.HashFilter, DataFrame, DataFrame]:
    """The filter, the rows it lets shuffle, and (text_sha256, keep_id, group_size) of their groups."""
    seen = repeat_filter.build(hashes.select(_first_64_bits(F.col("text_sha256")).alias("h")), hashes.count(), least=2)
    doubtful = hashes.filter(_maybe_repeated(F.col("text_sha256"), seen))
    groups = doubtful.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return seen, doubtful, stored(groups, "dedup-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    hashes = stored(text_hashes(docs, id_col, text_col), "dedup-hashes")
    seen, doubtful, groups = _filter_and_groups(hashes)
    alone = hashes.filter(~_maybe_repeated(F.col("text_sha256"), seen)).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    grouped = join_to_unique(doubtful, groups, "text_sha256", ["doc_id"], "inner", min_rows=SPLIT_FROM).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one text and one id, one stays."""
    hashes = stored(text_hashes(docs, id_col, text_col), "dedup-hashes")
    seen, _, groups = _filter_and_groups(hashes)
    digest, maybe, keep, size = ("_dedup_" + c for c in ("digest", "maybe", "keep", "size"))
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = docs.withColumn(digest, F.sha2(lowered, 256)).withColumn(maybe, _maybe_repeated(F.col(digest), seen))
    alone = marked.filter(~F.col(maybe)).drop(digest, maybe)
    groups = groups.toDF(digest, keep, size)
    best = join_to_unique(marked.filter(maybe), groups, digest, [id_col], "inner", min_rows=SPLIT_FROM)
    best = best.filter(F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([digest]).select(*docs.columns)
    return alone.unionByName(best)
