"""Approximate cosine search: an inverted file of vectors by cell, few cells probed, exact rescoring.

Cells are the nearest of a bounded number of centres, fitted on a bounded sample of the vectors; every vector is indexed.
A question visits the cells whose centres are nearest to it and is scored there against the stored vectors themselves, so
what is found has its exact score. How many cells that takes for a wanted recall is measured on a sample of the
indexed vectors and stored with the index. Probing all cells gives exactly what :func:`vectors.vector_search` gives.

Vectors that are NULL, empty, of another length than the centres, hold a NULL or have no direction take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.pick import top_per_key
from holdfast.operators.vectors import SCORE_DIGITS

# Vectors the centres are fitted on, and centres, at most; rounds of the fit.
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 65_536, 4_096, 8
# Sampled vectors that serve as questions when the number of cells to probe is measured.
TRIAL_QUERIES = 256
# Vectors of a cell and questions that one task compares at a time.
PART_ROWS, BLOCK_ROWS = 8_192, 1_024
# Scores that a task holds at a time: 8 MB.
_SCORES = 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``: cell and the input's columns; ``sizes``: (cell, rows), at most ``MOST_CELLS`` rows; ``probes``: cells for the wanted recall."""

    vectors: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    x = F.col("embedding")
    kept = vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull()) & F.exists(x, lambda v: v != 0))
    return kept if width is None else kept.filter(F.size(x) == width)


def fit_centres(rows: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means: unit rows to unit centres. A centre that loses all its rows stays where it was."""
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def probes_for(rows: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    """The fewest cells in which sampled questions find ``recall`` of their ``k`` nearest sampled rows."""
    asked = rows[:: max(1, len(rows) // TRIAL_QUERIES)]
    scores = asked @ rows.T
    best = np.argpartition(-scores, min(k, len(rows) - 1), axis=1)[:, : min(k + 1, len(rows))]  # the question itself is one of them
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    cell = (rows @ centres.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    own = len(asked)  # every question finds itself in its first cell; that must not count
    return int(needed[min(len(needed) - 1, own + math.ceil(recall * (len(needed) - own)) - 1)]) + 1


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            for low in range(0, len(batch), BLOCK_ROWS):  # the distances of a block to all centres are what a task holds
                some = batch.slice(low, BLOCK_ROWS)
                cell = (_unit(_matrix(some.column(at))) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *some.columns], ["cell", *batch.schema.names])

    return run


def _with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *vectors.schema.fields])
    placed = vectors.mapInArrow(_assign(centres), schema)
    # Row groups then cover few cells, and a cell with a third of all vectors still lies in many files.
    return placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")


def build_vector_index(
    vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 5, attributes: Sequence[str] = ()
) -> VectorIndex:
    """Index ``vectors`` (vec_id, embedding, attributes) below ``path``; about the square root of their number of cells."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select("vec_id", "embedding", *attributes))
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, total = (widths[0]["width"], widths[0]["count"]) if widths else (1, 0)
    rows = _usable(rows, width)
    # The sample is fixed by the ids, about SAMPLE_ROWS of them.
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total))) < SAMPLE_ROWS).select("embedding")
    sample = _matrix(some.toArrow().column(0)) if total else np.zeros((0, width))
    if len(sample):
        sample = _unit(sample[np.lexsort(sample.T)])[:SAMPLE_ROWS]
        centres = fit_centres(sample, cells or min(MOST_CELLS, max(1, round(math.sqrt(total)))))
        probes = probes_for(sample, centres, recall, k)
    else:
        centres, probes = np.eye(1, width), 1
    _with_cells(rows, centres).write.mode("errorifexists").parquet(f"{path}/vectors")
    fit = spark.createDataFrame([(probes, [c.tolist() for c in centres])], "probes int, centres array<array<double>>")
    fit.coalesce(1).write.mode("errorifexists").parquet(f"{path}/fit")
    return open_vector_index(spark, path)


def add_vectors(index: VectorIndex, vectors: DataFrame, path: str) -> VectorIndex:
    """Append further vectors to the cells they belong to; nothing that is stored is read or moved."""
    names = [c for c in index.vectors.columns if c != "cell"]
    rows = _usable(vectors.select(*names), index.centres.shape[1])
    _with_cells(rows, index.centres).write.mode("append").parquet(f"{path}/vectors")
    return open_vector_index(vectors.sparkSession, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    fit = spark.read.parquet(f"{path}/fit").first()
    vectors = spark.read.parquet(f"{path}/vectors")
    sizes = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    return VectorIndex(vectors, sizes, np.array(fit["centres"]), fit["probes"])


def _nearest_cells(centres: np.ndarray, probes: int):
    """Rows (query_id, embedding) to (query_id, embedding, cell) for the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK_ROWS):
                some = batch.slice(low, BLOCK_ROWS)
                scores = _unit(_matrix(some.column(1))) @ centres.T
                cell = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                own = np.repeat(np.arange(len(some)), cell.shape[1])
                for first in range(0, len(own), PART_ROWS):  # a question is copied to each of its cells, so copies leave in parts
                    rows = pa.array(own[first : first + PART_ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(rows), some.column(1).take(rows), pa.array(cell.ravel()[first : first + PART_ROWS])], ["query_id", "embedding", "cell"]
                    )

    return run


def _best_in_parts(k: int, names: list[str]):
    """Rows sorted by (cell, part, kind): the vectors of a part, then questions; the ``k`` best vectors of the part for each."""

    def best(questions: pa.RecordBatch, held: pa.Table, order: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        at_once = max(1, min(BLOCK_ROWS, _SCORES // len(rows)))
        for low in range(0, len(questions), at_once):
            some = questions.slice(low, at_once)
            scores = np.round(_unit(_matrix(some.column("embedding"))) @ rows.T, SCORE_DIGITS)
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ties to the smaller id
            q = np.repeat(np.arange(len(some)), first.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("query_id").take(pa.array(q)),
                    held["vec_id"].take(pa.array(order[first.ravel()])).combine_chunks(),
                    pa.array(scores[q, first.ravel()]),
                ],
                names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ready = None, [], None
        for batch in batches:
            cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
            change = (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(batch)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if (cell[lo], part[lo]) != now:
                    now, vectors, ready = (cell[lo], part[lo]), [], None
                some = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    vectors.append(some)
                elif vectors:  # the vectors of a part come first; questions are answered as they arrive, never gathered
                    if ready is None:
                        held = pa.Table.from_batches(vectors)
                        order = np.argsort(held["vec_id"].to_numpy(), kind="stable")
                        ready = held.select(["vec_id"]), order, _unit(_matrix(held["embedding"]))[order]
                    yield from best(some, *ready)

    return run


def approximate_search(
    index: VectorIndex, queries: DataFrame, query_id: str, k: int = 5, probes: int | None = None, where: Column | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` vectors in the probed cells, with their exact cosine.

    A question goes to the parts of its cells only; cells that none asks for are not read. Large cells
    fall into parts of about ``part_rows`` vectors, so one with a third of all vectors makes many tasks.
    """
    probes = min(probes or index.probes, len(index.centres))
    asked = _usable(queries, index.centres.shape[1]).select(F.col(query_id).alias("query_id"), "embedding").dropDuplicates(["query_id"])
    schema = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
    visits = asked.mapInArrow(_nearest_cells(index.centres, probes), schema)
    parts = F.broadcast(index.sizes.select("cell", F.ceil(F.col("rows") / part_rows).cast("int").alias("_parts")))  # MOST_CELLS rows at most
    wanted = [r["cell"] for r in visits.select("cell").distinct().collect()]
    stored = index.vectors.filter(F.col("cell").isin(wanted)) if len(wanted) < len(index.centres) else index.vectors
    stored = stored if where is None else stored.filter(where)
    split = F.pmod(F.xxhash64("vec_id"), "_parts").cast("int")
    no_query, no_vector = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((asked, "query_id"), (index.vectors, "vec_id")))
    embedding = F.col("embedding").cast("array<double>").alias("embedding")
    held = stored.join(parts, "cell").select("cell", split.alias("part"), F.lit(0).alias("kind"), "vec_id", no_query.alias("query_id"), embedding)
    copies = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    sent = visits.join(parts, "cell").select("cell", copies.alias("part"), F.lit(1).alias("kind"), no_vector.alias("vec_id"), "query_id", embedding)
    work = held.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    names = ["query_id", "vec_id", "score"]
    found = work.mapInArrow(_best_in_parts(k, names), T.StructType([asked.schema["query_id"], index.vectors.schema["vec_id"], T.StructField("score", T.DoubleType())]))
    top = top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")
    return top.select("query_id", "rank", "vec_id", "score")


def probe_report(index: VectorIndex, queries: DataFrame, query_id: str, probes: int | None = None) -> DataFrame:
    """One row: queries, cells, cells probed by a query, vectors compared a query on average, vectors indexed."""
    probes = min(probes or index.probes, len(index.centres))
    asked = _usable(queries, index.centres.shape[1]).select(F.col(query_id).alias("query_id"), "embedding").dropDuplicates(["query_id"])
    schema = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
    visits = asked.mapInArrow(_nearest_cells(index.centres, probes), schema).join(F.broadcast(index.sizes), "cell")
    total = index.sizes.agg(F.sum("rows")).scalar()
    seen = visits.agg(F.count_distinct("query_id").alias("queries"), F.sum("rows").alias("_rows"))
    return seen.select(
        "queries", F.lit(len(index.centres)).alias("cells"), F.lit(probes).alias("probes"), (F.col("_rows") / F.col("queries")).alias("rows_compared"), total.alias("rows_indexed")
    )


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: expected hits, hits found, their share; a hit with the score of the last exact one counts as it."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("_last"), F.count(F.lit(1)).alias("_n"))
    met = found.join(last, "query_id").filter(F.col("score") >= F.col("_last")).groupBy("query_id").agg(F.count(F.lit(1)).alias("_met"))
    both = last.join(met, "query_id", "left").agg(F.sum("_n").alias("expected"), F.sum(F.least("_n", F.coalesce("_met", F.lit(0)))).alias("found"))
    return both.withColumn("recall", F.col("found") / F.col("expected"))
