"""Exact cosine search over a table of embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.columns import exact_avg
from holdfast.operators.pick import top_per_key

SCORE_DIGITS = 6
# Vectors of a shard, queries of a block, and the scores, 8 MB, that a task holds at a time.
SHARD_ROWS, BLOCK_ROWS = 8_192, 1_024
_SCORES = 1 << 20


def centroids(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """(group, embedding): mean vector per group; the shuffle carries one number per group and dimension."""
    numbers = vectors.select(group, F.posexplode(embedding).alias("pos", "x"))
    means = numbers.groupBy(group, "pos").agg(exact_avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))  # as long as the vectors are wide
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["x"]).alias(embedding))


def _usable(lists) -> tuple:
    """(places of rows that have a direction, their vectors of length one)."""
    import numpy as np

    rows = np.array(lists, dtype=np.float64).reshape(len(lists), -1)
    norms = np.linalg.norm(rows, axis=1)
    kept = np.flatnonzero(norms > 0)  # the cosine of a zero vector is undefined
    return kept, rows[kept] / norms[kept, None]


def _pack(rows_at_once: int):
    """Rows (id, embedding) to blocks (block, data) of a bounded number of rows."""

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pandas as pd

        block, ids, lists = 0, [], []

        def packed():
            kept, rows = _usable(lists)
            return pd.DataFrame({"block": [block], "data": [pickle.dumps(([ids[i] for i in kept], rows))]})

        for batch in batches:
            for name, embedding in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                ids.append(name)
                lists.append(embedding)
                if len(ids) == rows_at_once:
                    yield packed()
                    block, ids, lists = block + 1, [], []
        if ids:
            yield packed()

    return run


def _best_of_shards(k: int, digits: int):
    """A shard's vectors (block -1), then blocks of queries: the ``k`` best vectors of the shard for each query."""

    def run(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pandas as pd

        names, rows = [], None
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"]):
                ids, matrix = pickle.loads(data)
                if block < 0:
                    names, rows = np.array(ids, dtype=object), matrix
                    order = np.argsort(names, kind="stable")
                    names, rows = names[order], rows[order]
                    continue
                if not len(ids) or not len(names):
                    continue
                at_once = max(1, _SCORES // len(names))
                for low in range(0, len(ids), at_once):
                    some = ids[low : low + at_once]
                    scores = np.round(matrix[low : low + at_once] @ rows.T, digits)
                    kth = np.partition(scores, max(len(names) - k, 0), axis=1)[:, max(len(names) - k, 0)]
                    q, at = np.nonzero(scores >= kth[:, None])  # with all that tie at the last place
                    best = np.lexsort((at, -scores[q, at], q))
                    q, at = q[best], at[best]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, at = q[place < k], at[place < k]
                    yield pd.DataFrame({"query_id": [some[i] for i in q], "vec_id": list(names[at]), "score": scores[q, at]})

    return run


def vector_search(
    vectors: DataFrame,
    queries: DataFrame,
    query_id: str,
    k: int = 5,
    where: Column | None = None,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): exact top ``k`` by cosine for every query vector.

    The vectors are dealt evenly to shards of bounded size and the queries packed into blocks; each
    block goes to each shard, where one matrix product scores it. A shard returns ``k`` rows a
    query and a window merges the shards. Nothing is collected; vectors that are NULL or hold a NULL take no part.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    corpus = (vectors if where is None else vectors.filter(where)).filter(whole).select("vec_id", "embedding")
    wanted = queries.filter(whole).select(F.col(query_id).alias("query_id"), "embedding").dropDuplicates(["query_id"])
    shards = max(1, math.ceil(corpus.count() / shard_rows))
    packed = "block int, data binary"
    dealt = corpus.repartition(shards).mapInPandas(_pack(1 << 62), packed)
    dealt = dealt.select(F.spark_partition_id().alias("shard"), F.lit(-1).alias("block"), "data")
    blocks = wanted.mapInPandas(_pack(block_rows), packed)
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "data")
    work = dealt.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    schema = T.StructType(
        [
            T.StructField("query_id", wanted.schema["query_id"].dataType),
            T.StructField("vec_id", corpus.schema["vec_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    found = work.mapInPandas(_best_of_shards(k, SCORE_DIGITS), schema)
    top = top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")
    return top.select("query_id", "rank", "vec_id", "score")
