"""Exact top-k search by inner product with a KD-tree for each shard.

The rows are dealt evenly to shards. A shard's tree splits at medians of its widest dimension; every node keeps a tight
bounding box and its smallest id. The highest score that a box can hold is the sum over dimensions of the better of its two
sides. Queries visit a shard together, a block at a time: they descend level by level into the boxes that can
still beat their k-th best score, then visit the leaves best-first, with the k-th score growing all the time. Before the
first shard the k-th score comes from the other queries of the block, and a task hands it on from leaf to leaf, so
each shard returns the few rows that can still count.

Trees and blocks of queries are single binary values of bounded size. Scores are integers computed in doubles, exact
while dimension * (largest component)**2 stays below 2**53. Rows with a larger component are kept out of the trees and
scored in Python integers, as candidates of all queries and as queries of all candidates.

Each length of vectors is searched for itself: the commonest and all with more rows than a shard by shards, the others one
length a task.

Cases: vectors that are null, empty or hold a null, NaN or infinite component take no part as query or candidate, and
neither do rows without id; a score beyond 64 bits is ranked rightly and shown as null; ties go to the smaller id; rows repeated as a whole (one id) are
separate candidates, but none is a candidate of a query with its own id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterable, Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of a shard, of a leaf, and of a block of queries.
SHARD_ROWS = 8_192
LEAF_ROWS = 256
BLOCK_ROWS = 1_024
# Rows of a shard that is scored in Python integers.
WHOLE_ROWS = 1_024
SCALE = 256.0


def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer components as doubles) of the rows of an Arrow batch (id, list of doubles)."""
    lists = batch.column(1)
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), values


class KDTree:
    """A complete binary tree over rows in leaf order; node i has the children 2i and 2i + 1."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.levels = max(0, int(np.ceil(np.log2(max(len(ids), 1) / leaf_rows))))
        order = np.arange(len(ids))
        spans = {1: (0, len(ids))}
        for node in range(1, 1 << self.levels):
            a, b = spans[node]
            part = order[a:b]
            half = (b - a) // 2
            if len(part) > 1:
                values = rows[part]
                widest = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
                order[a:b] = part[np.argpartition(values[:, widest], half)]
            spans[2 * node], spans[2 * node + 1] = (a, a + half), (a + half, b)
        self.ids, self.rows = ids[order], rows[order].astype(np.int32)
        self.spans = np.zeros((2 << self.levels, 2), np.int64)
        size = rows.shape[1]
        self.low, self.high = np.zeros((2 << self.levels, size)), np.zeros((2 << self.levels, size))
        self.least_id = np.full(2 << self.levels, np.iinfo(np.int64).max)
        for node, (a, b) in spans.items():
            self.spans[node] = a, b
            if b > a:
                self.low[node], self.high[node] = self.rows[a:b].min(axis=0), self.rows[a:b].max(axis=0)
                self.least_id[node] = self.ids[a:b].min()


class Best:
    """The k best (score, id) so far of each query of a block; a better score or, at a tie, a smaller id wins."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each query of ``which``, a column for each id."""
        if scores.shape[1] > 4 * self.k:  # first by score alone, with all that tie at the last place
            edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            tied = (scores >= np.maximum(edge, self.scores[which, -1])[:, None]).sum(axis=1).max()
            if tied <= 4 * self.k:
                at = np.argpartition(-scores, min(4 * self.k, scores.shape[1] - 1), axis=1)[:, : 4 * self.k]
                ids, scores = ids[at], np.take_along_axis(scores, at, axis=1)
        ids = np.broadcast_to(ids, scores.shape)
        all_scores = np.concatenate([self.scores[which], scores], axis=1)
        all_ids = np.concatenate([self.ids[which], ids], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[which] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[which] = np.take_along_axis(all_ids, order, axis=1)


def search_tree(tree: KDTree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Best:
    """The best rows of one shard. ``kth``: a score that at least k candidates of each query reach somewhere."""
    best = Best(len(query_ids), k)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)

    def bounds(nodes: np.ndarray) -> np.ndarray:
        return up @ tree.high[nodes].T + down @ tree.low[nodes].T

    alive, nodes = np.ones((len(query_ids), 1), bool), np.array([1])
    for _ in range(tree.levels):  # descend where the box can still hold a score that counts
        nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
        alive = np.repeat(alive, 2, axis=1)
        used = alive.any(axis=0)
        nodes, alive = nodes[used], alive[:, used]
        alive &= bounds(nodes) >= kth[:, None]
    if not len(nodes):
        return best
    reach = np.where(alive, bounds(nodes), -np.inf)
    order = np.argsort(-reach, axis=1)
    active = np.arange(len(query_ids))
    for turn in range(len(nodes)):  # each query's next best leaf
        leaf = order[active, turn]
        bound = reach[active, leaf]
        least = np.maximum(kth[active], best.scores[active, -1])
        active, leaf, bound = (x[(bound >= least) & (bound > -np.inf)] for x in (active, leaf, bound))
        if not len(active):
            break
        full = best.scores[active, -1] == bound  # a tie counts only with a smaller id
        useful = ~full | (tree.least_id[nodes[leaf]] < best.ids[active, -1])
        going, to = active[useful], leaf[useful]
        by_leaf = np.argsort(to, kind="stable")
        going, to = going[by_leaf], to[by_leaf]
        for some in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            if not len(some):
                continue
            a, b = tree.spans[nodes[to[some[0]]]]
            which = going[some]
            scores = queries[which] @ tree.rows[a:b].T.astype(np.float64)
            scores[query_ids[which][:, None] == tree.ids[a:b]] = -np.inf
            scores[scores < kth[which][:, None]] = -np.inf
            best.offer(which, scores, tree.ids[a:b])
    return best


def _build_shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_vectors(b, size) for b in batches if b.num_rows]
        if parts:
            tree = KDTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-1], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())],
                ["shard", "block", "data"],
            )

    return run


def _build_blocks(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                ids, rows = _vectors(batch.slice(at, BLOCK_ROWS), size)
                scores = rows @ rows.T  # the queries are candidates of each other: a first k-th score
                scores[ids[:, None] == ids] = -np.inf
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(ids), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), pa.array([pickle.dumps((ids, rows.astype(np.int32), kth))], pa.binary())], ["block", "data"]
                )
                n += 1

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for shard, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:  # a shard's tree comes before its blocks of queries
                    tree, at = pickle.loads(data), shard
                    continue
                if at != shard:
                    raise ValueError("queries without their shard")
                ids, rows, kth = pickle.loads(data)
                best = search_tree(tree, ids, rows.astype(np.float64), kth, k)
                q, rank = np.nonzero(best.scores > -np.inf)
                found = [pa.array(ids[q]), pa.array(best.ids[q, rank]), pa.array(best.scores[q, rank].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(found, ["query_id", "vec_id", "score"])

    return run


def whole_numbers(values: Iterable[float], scale: float) -> list[int]:
    """floor(scale * x) of finite components of any size."""
    return [math.floor(y) if math.isfinite(y := x * scale) else math.floor(Fraction(x) * Fraction(scale)) for x in values]


Found = tuple[int, int, int, int | None, bytes | None]


def search_whole(query_ids: Iterable[int], queries: list[list[int]], ids: list[int], rows: list[list[int]], k: int) -> Iterator[Found]:
    """(query, id, tier, score, size) of the ``k`` best rows; a score beyond 64 bits has a tier and bytes that sort like it instead."""
    for query_id, query in zip(query_ids, queries, strict=True):
        scores = ((-sum(map(mul, query, row)), i) for i, row in zip(ids, rows, strict=True) if i != query_id)
        for score, i in heapq.nsmallest(k, scores):
            score = -score
            if -(2**63) <= score < 2**63:
                yield query_id, i, 0, score, None
                continue
            length = (abs(score).bit_length() + 7) // 8
            size = length.to_bytes(4) + abs(score).to_bytes(length)
            yield (query_id, i, 1, None, size) if score > 0 else (query_id, i, -1, None, bytes(255 - b for b in size))


_FOUND = "query_id bigint, vec_id bigint, tier int, score bigint, size binary"


def _found(rows: list[Found]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "tier", "score", "size"])


def _whole_blocks(size: int, block_rows: int, as_shard: bool):
    """Blocks of vectors with components of any size: one for each partition that is a shard, else of ``block_rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.slice(at, block_rows)) for b in batches for at in range(0, b.num_rows, block_rows)]
        blocks = [_vectors(p, size) for p in parts]
        if as_shard and blocks:
            blocks = [(np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]))]
        for n, block in enumerate(blocks):
            data = pa.array([pickle.dumps(block)], pa.binary())
            at = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-1], pa.int32())] if as_shard else [pa.array([n], pa.int32())]
            yield pa.RecordBatch.from_arrays([*at, data], ["shard", "block", "data"] if as_shard else ["block", "data"])

    return run


def _search_whole(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, at = [], [], None
        for batch in batches:
            for shard, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found_ids, values = pickle.loads(data)
                whole = [whole_numbers(v, scale) for v in values.tolist()]
                if block < 0:
                    ids, rows, at = found_ids.tolist(), whole, shard
                elif at == shard:  # else no row was dealt to the shard
                    yield _found([*search_whole(found_ids.tolist(), whole, ids, rows, k)])

    return run


def _search_length(k: int, scale: float):
    """All queries and candidates of one length, which has at most the rows of a shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()[0]
        ids, raw = _vectors(rows, len(rows.column(1)[0]))
        is_query, large = (rows.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
        found: list[Found] = []
        if (~large).any():
            small = np.floor(raw[~large] * scale)
            tree = KDTree(ids[~large], small)
            asked_ids, asked = ids[~large & is_query], small[is_query[~large]]
            for a in range(0, len(asked), BLOCK_ROWS):
                best = search_tree(tree, asked_ids[a : a + BLOCK_ROWS], asked[a : a + BLOCK_ROWS], np.full(len(asked[a : a + BLOCK_ROWS]), -np.inf), k)
                q, rank = np.nonzero(best.scores > -np.inf)
                found += [(x, y, 0, int(z), None) for x, y, z in zip(asked_ids[a + q].tolist(), best.ids[q, rank].tolist(), best.scores[q, rank].tolist(), strict=True)]
        for queries, candidates in ((is_query, large), (is_query & large, ~large)):
            if queries.any() and candidates.any():
                asked, held = ([whole_numbers(v, scale) for v in raw[x].tolist()] for x in (queries, candidates))
                found += search_whole(ids[queries].tolist(), asked, ids[candidates].tolist(), held, k)
        return pa.Table.from_batches([_found(found)])

    return run


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, v, large) of the usable rows: components as doubles, whether scores with them can pass the exact range of doubles."""
    raw = F.col(vector_col)
    usable = raw.isNotNull() & F.col(id_col).isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    doubles = F.transform(raw, lambda x: x.cast("double"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x * scale))) + 1
    out = rows.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), doubles.alias("v")).filter(F.size("v") > 0)
    return out.withColumn("large", F.size("v") * most * most >= float(2**53))


def _top_whole(candidates: DataFrame, queries: DataFrame, size: int, n: int, k: int, scale: float) -> DataFrame:
    """Rows of _FOUND: the best of ``n`` candidates in Python integers."""
    shards = max(1, -(-n // WHOLE_ROWS))
    held = candidates.select("vec_id", "v").repartition(shards).mapInArrow(_whole_blocks(size, WHOLE_ROWS, True), "shard int, block int, data binary")
    asked = queries.select("vec_id", "v").mapInArrow(_whole_blocks(size, BLOCK_ROWS, False), "block int, data binary")
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "data")
    work = held.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return work.mapInArrow(_search_whole(k, scale), _FOUND)


def _top_of_shards(vectors: DataFrame, queries: DataFrame, size: int, n: int, k: int, shard_rows: int, scale: float) -> DataFrame:
    """query_id, vec_id, score: the best of ``n`` vectors in each shard, all within the exact range."""
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")
    shards = max(1, -(-n // shard_rows))
    trees = vectors.select("vec_id", whole).repartition(shards).mapInArrow(_build_shards(size), "shard int, block int, data binary")
    blocks = queries.select("vec_id", whole).mapInArrow(_build_blocks(size, k), "block int, data binary")
    # Each block of queries goes to each shard: (rows / shard_rows) * (query rows / block) values in all, and no row pairs.
    copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "data")
    work = trees.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return work.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row with ``is_query``, its own id left out."""
    vectors = usable_vectors(rows, id_col, vector_col, scale)
    counts = vectors.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("large"))
    # One row for each length with more rows than a shard, and one for all others.
    many = F.when(F.col("n") > shard_rows, F.col("size"))
    sizes = counts.groupBy(many.alias("many")).agg(F.count(F.lit(1)).alias("lengths"), F.max(F.struct("n", "size", "large")).alias("most")).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dealt = [r["most"] for r in sizes if r["many"] is not None] or [max(r["most"] for r in sizes)]
    others = sum(r["lengths"] for r in sizes) > len(dealt)
    plain = not others and not any(x["large"] for x in dealt)

    def asked(some: DataFrame) -> DataFrame:
        return some.withColumnRenamed("vec_id", id_col).filter(is_query).withColumnRenamed(id_col, "vec_id")

    parts = []
    for n, size, large in dealt:
        of_size = vectors.filter(F.size("v") == size)
        small = of_size.filter(~F.col("large")) if large else of_size
        found = _top_of_shards(small, asked(small), size, n - large, k, shard_rows, scale)
        parts.append(found if plain else found.select("query_id", "vec_id", F.lit(0).alias("tier"), "score", F.lit(None).cast("binary").alias("size")))
        if large:
            those = of_size.filter("large")
            parts += [_top_whole(those, asked(of_size), size, large, k, scale), _top_whole(small, asked(those), size, n - large, k, scale)]
    if others:
        rest = vectors.filter(~F.size("v").isin([x["size"] for x in dealt]))
        flagged = rest.withColumnRenamed("vec_id", id_col).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
        one_length = flagged.select(F.col(id_col).alias("vec_id"), "v", "is_query", "large", F.size("v").alias("length"))
        parts.append(one_length.groupBy("length").applyInArrow(_search_length(k, scale), _FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), "vec_id"] if plain else [F.desc("tier"), F.desc("score"), F.desc("size"), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
