"""A search index kept up by immutable segments, and ranking that skips postings by upper bounds.

New documents become a segment of their own; nothing that is stored is read or changed for it. A segment consists of shards of at
most ``SHARD_DOCS`` documents and about ``SHARD_POSTINGS`` postings. For each term a shard holds one packed list: the places of its documents, how often each
has the term, and with them the largest count and the shortest document, from which a bound of the term's weight
follows whatever the mean length of the corpus becomes. Document frequencies are sums of list sizes and corpus totals sums over
segments, so both are deltas that merge by addition. Segments of one size tier are merged when there are ``FAN`` of
them, so their number grows with the logarithm of the corpus.

Ranking is BM25 as in :mod:`search`. Blocks of questions meet the lists of their terms shard by shard. Within a
shard a question's terms come in the order of their bounds; as soon as the terms that are left can't lift a document
that was not met yet to the k-th score, their lists are only looked into for documents that still can reach
it. What leaves a shard is ``k`` rows a question, never a row for each question and document.

The list of live segments is a small table of its own, replaced as a whole, so readers see whole states only.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.pick import one_per_key, top_per_key
from holdfast.operators.quality import union_all
from holdfast.operators.search import B, K1, SCORE_DIGITS, SEARCH_LIMIT, word_array
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import remove_folder, subfolders, written_keys

# Documents of a shard, questions of a block, segments of a tier that are merged into one.
SHARD_DOCS, BLOCK_QUERIES, FAN = 20_000, 512, 4
# Postings of a shard: about 30 bytes each while it is made, whatever the length of the documents.
SHARD_POSTINGS = 2_000_000
# Postings that are unpacked together.
UNPACKED_ROWS = 65_536
LIVE = "segments"
# Scores this close may be equal once they are rounded, and then the smaller id comes first.
_ROUNDING = 2 * 10.0**-SCORE_DIGITS
_LIVE_SCHEMA = "segment string, tier int, n_docs bigint, n_words bigint"


def _shard_fields(doc_type: T.DataType) -> list[T.StructField]:
    """A row is a posting list (term set) or the documents of a shard (ids set)."""
    return [
        T.StructField("shard", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("most", T.IntegerType()),
        T.StructField("shortest", T.IntegerType()),
        T.StructField("ids", T.ArrayType(doc_type)),
    ]


_NAMES = ["shard", "term", "n", "places", "counts", "most", "shortest", "ids"]


def _list_rows(shard: str, terms: pa.Array, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, lengths: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """The lists of a shard ordered by term, and one row with its documents: their lengths in ``counts``.

    ``places`` and ``counts`` hold the lists of all terms one after the other, ``sizes`` how long each is; no object is made for a list.
    """
    rows = len(terms) + 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = pa.py_buffer((4 * ends).astype(np.int32))
    lists = (pa.Array.from_buffers(pa.binary(), len(terms), [None, at, pa.py_buffer(x)]) for x in (places, counts))
    extremes = (np.maximum.reduceat(counts, ends[:-1]), np.minimum.reduceat(lengths[places], ends[:-1])) if len(terms) else ([], [])
    offsets = pa.array([0] * rows + [len(ids)], pa.int32())
    lasts = (pa.array([x], pa.binary()) for x in (None, lengths.tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(shard, pa.string()), rows),
            pa.concat_arrays([terms, pa.nulls(1, pa.string())]),
            pa.array(np.append(sizes, len(ids)), pa.int64()),
            *(pa.concat_arrays([x, last]) for x, last in zip(lists, lasts, strict=True)),
            *(pa.concat_arrays([pa.array(x, pa.int32()), pa.nulls(1, pa.int32())]) for x in extremes),
            pa.ListArray.from_arrays(offsets, ids),
        ],
        _NAMES,
    )


def _counted(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of some word lists, their distinct words, and for each word of a list: its place among these, the list, how often it occurs."""
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int32)
    coded = lists.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs = np.repeat(np.arange(len(lengths), dtype=np.int64) * width, lengths) + coded.indices.to_numpy()
    found, counts = np.unique(pairs, return_counts=True)
    at, of = np.divmod(found, width)
    return lengths, coded.dictionary.cast(pa.string()), of.astype(np.int32), at.astype(np.int32), counts.astype(np.int32)


def _build_shards(shard_docs: int, shard_postings: int):
    """Rows (doc_id, words) to shards; a task starts a new one after ``shard_docs`` documents or ``shard_postings`` postings.

    Words are counted 64 documents at a time and numbered for the whole shard at its end; no object is made for a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        parts, n_docs, n_words, n_postings = [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            ids, lengths, words, of, places, counts = zip(*parts, strict=True)
            lengths, of, places, counts = (np.concatenate(x) for x in (lengths, of, places, counts))
            coded = pa.concat_arrays(words).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            own = rank[coded.indices.to_numpy()[of]]
            by_term = np.argsort(own, kind="stable")
            sizes = np.bincount(own, minlength=len(order))
            return _list_rows(f"{task:06d}-{made:06d}", coded.dictionary.take(pa.array(order)), sizes, places[by_term], counts[by_term], lengths, pa.concat_arrays([i.cast(ids[0].type) for i in ids]))

        for batch in batches:
            for low in range(0, len(batch), 64):
                some = batch.slice(low, 64)
                lengths, words, of, places, counts = _counted(some.column(1))
                parts.append((some.column(0), lengths, words, of + np.int32(n_words), places + np.int32(n_docs), counts))
                n_docs, n_words, n_postings = n_docs + len(some), n_words + len(words), n_postings + len(of)
                if n_docs >= shard_docs or n_postings >= shard_postings:
                    yield shard()
                    made += 1
                    parts, n_docs, n_words, n_postings = [], 0, 0, 0
        if parts:
            yield shard()

    return run


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (to, term nulls first, shard): the documents of the shards first, then their lists in the order of the terms."""
    now, offsets, lengths, ids, terms, sizes, places, counts = None, {}, [], [], [], [], bytearray(), bytearray()

    def merged() -> pa.RecordBatch:
        lists = (np.frombuffer(x, np.int32) for x in (places, counts))
        return _list_rows(now, pa.array(terms, pa.string()), np.array(sizes, np.int64), *lists, np.concatenate(lengths), pa.concat_arrays(ids))

    for batch in batches:
        names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for row, (to, shard, term) in enumerate(zip(*(names[n].to_pylist() for n in ("to", "shard", "term")), strict=True)):
            if to != now:
                if now is not None:
                    yield merged()
                now, offsets, lengths, ids, terms, sizes, places, counts = to, {}, [], [], [], [], bytearray(), bytearray()
            found = np.frombuffer(names["counts"][row].as_py(), np.int32)
            if term is None:
                offsets[shard] = sum(map(len, lengths))
                lengths.append(found)
                ids.append(names["ids"][row].values)
                continue
            if not terms or terms[-1] != term:
                terms.append(term)
                sizes.append(0)
            sizes[-1] += len(found)
            places += (np.frombuffer(names["places"][row].as_py(), np.int32) + np.int32(offsets[shard])).tobytes()
            counts += found.tobytes()
    if now is not None:
        yield merged()


@dataclass(frozen=True)
class Corpus:
    n_docs: int
    n_words: int

    @property
    def mean(self) -> float:
        return self.n_words / self.n_docs if self.n_docs and self.n_words else 1.0


class SegmentedIndex:
    """The index below the root of ``tables``; one writer at a time."""

    def __init__(self, tables: Tables, doc_id: str, text: str, attributes: Sequence[str] = (), name: str = "search", shard_docs: int = SHARD_DOCS, fan: int = FAN):
        self.spark, self.live = tables.spark, Tables(tables.spark, f"{tables.root}/{name}")
        self.doc_id, self.text, self.attributes, self.shard_docs, self.fan = doc_id, text, tuple(attributes), shard_docs, fan

    def segments(self) -> list:
        """The live segments; few rows, see the module's text."""
        return self.live.read(LIVE).orderBy("segment").collect() if self.live.exists(LIVE) else []

    def _path(self, segment: str, part: str) -> str:
        return f"{self.live.root}/{segment}/{part}"

    def _read(self, part: str, segments: Sequence | None = None) -> DataFrame | None:
        some = self.segments() if segments is None else segments
        frames = [self.spark.read.parquet(self._path(s["segment"], part)).withColumn("segment", F.lit(s["segment"])) for s in some]
        return union_all(frames) if frames else None

    def _publish(self, rows: list[tuple]) -> None:
        self.live.replace(LIVE, self.spark.createDataFrame(rows, _LIVE_SCHEMA).coalesce(1))

    def add(self, docs: DataFrame, stored: bool = False) -> None:
        """Index the documents whose id is new, each id once. Adding the same again adds nothing; no stored posting is read.

        ``stored`` says that ``docs`` reads files that stay as they are; otherwise the new rows are written first, so that every later step reads the same.
        """
        segments = self.segments()
        docs = docs.select(F.col(self.doc_id).alias("doc_id"), *self.attributes, F.col(self.text).alias("_text"))
        rows = one_per_key(docs, "doc_id")
        known = self._read("documents", segments)
        if known is not None:
            # Ids meet ids; those that are there already are written, so that a few of them are broadcast and no text moves.
            rows = rows.join(written_keys(known.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")), "doc_id", "left_anti")
        segment = f"s-{uuid.uuid4().hex}"
        if not stored:
            rows.write.parquet(self._path(segment, "rows"))
            rows = self.spark.read.parquet(self._path(segment, "rows"))
        words = rows.select("doc_id", F.coalesce(word_array("_text"), F.array().cast("array<string>")).alias("words"))
        schema = T.StructType(_shard_fields(rows.schema["doc_id"].dataType))
        words.mapInArrow(_build_shards(self.shard_docs, SHARD_POSTINGS), schema).write.parquet(self._path(segment, "shards"))
        n_docs, n_words = self._sizes_of(segment)
        if not n_docs:
            remove_folder(self.spark, f"{self.live.root}/{segment}")
            return
        rows.drop("_text").write.parquet(self._path(segment, "documents"))
        self._publish([tuple(s) for s in segments] + [(segment, 0, n_docs, n_words)])
        remove_folder(self.spark, self._path(segment, "rows"))
        self._merge_tiers()

    def _sizes_of(self, segment: str) -> tuple[int, int]:
        """Documents of a segment and their words."""
        heads = self.spark.read.parquet(self._path(segment, "shards")).filter("term is null").select("n", "counts")
        sizes = heads.select("n", _total("counts").alias("t")).agg(F.sum("n"), F.sum("t")).first()
        return int(sizes[0] or 0), int(sizes[1] or 0)

    def _merge_tiers(self) -> None:
        """Put the segments of a tier together while there are ``fan`` of them."""
        while True:
            segments = self.segments()
            tiers = Counter(s["tier"] for s in segments)
            full = min((t for t, n in tiers.items() if n >= self.fan), default=None)
            if full is None:
                return
            some = [s for s in segments if s["tier"] == full]
            merged = f"s-{uuid.uuid4().hex}"
            shards = self._read("shards", some).withColumn("shard", F.concat_ws("/", "segment", "shard"))
            held = F.col("term").isNull()
            sizes = shards.groupBy("shard").agg(F.sum(F.when(held, F.col("n"))).alias("docs"), F.sum(F.when(~held, F.col("n"))).alias("postings"))
            # Documents, or as many as stand for the postings.
            full_by = F.ceil(F.coalesce("postings", F.lit(0)) * self.shard_docs / SHARD_POSTINGS).cast("bigint")
            sizes = sizes.select("shard", F.greatest("docs", full_by).alias("n"))
            # Shards are put together in the order of their names until the documents or postings of one are full; a window over few rows:
            # one for each shard of the segments that are merged.
            upto = F.sum("n").over(Window.orderBy("shard"))
            to = F.format_string("m-%08d", F.floor((upto - 1) / self.shard_docs).cast("int"))
            target = F.broadcast(sizes.select("shard", to.alias("to")))
            laid = shards.drop("segment").join(target, "shard").repartition("to").sortWithinPartitions(F.col("to"), F.col("term").asc_nulls_first(), F.col("shard"))
            schema = self.spark.read.parquet(self._path(some[0]["segment"], "shards")).schema
            laid.mapInArrow(_merge_shards, schema).write.parquet(self._path(merged, "shards"))
            self._read("documents", some).drop("segment").write.parquet(self._path(merged, "documents"))
            row = (merged, full + 1, sum(s["n_docs"] for s in some), sum(s["n_words"] for s in some))
            self._publish([tuple(s) for s in segments if s["tier"] != full] + [row])

    def vacuum(self) -> None:
        """Remove segments that are no longer live, and earlier lists of them. Not while others still read them."""
        live = {s["segment"] for s in self.segments()}
        for name in subfolders(self.spark, self.live.root):
            if name.startswith("s-") and name not in live:
                remove_folder(self.spark, f"{self.live.root}/{name}")
        self.live.vacuum(LIVE)

    # --- what the index holds

    def corpus(self) -> Corpus:
        segments = self.segments()
        return Corpus(sum(s["n_docs"] for s in segments), sum(s["n_words"] for s in segments))

    def lists(self) -> DataFrame | None:
        shards = self._read("shards")
        return None if shards is None else shards.withColumn("shard", F.concat_ws("/", "segment", "shard")).drop("segment")

    def term_statistics(self) -> DataFrame:
        """(term, df), from the sizes of the lists."""
        return self.lists().filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))

    def postings(self) -> DataFrame:
        """(doc_id, term, tf, length), unpacked."""
        lists = self.lists()
        schema = T.StructType([T.StructField("doc_id", lists.schema["ids"].dataType.elementType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("length", T.LongType())])
        # Sorted by one number: shards by their hash, and in its last bit the documents before the lists.
        own = F.xxhash64("shard").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("term").isNotNull().cast("bigint"))
        laid = lists.select("shard", "term", "places", "counts", "ids", own.alias("_own")).repartition("shard").sortWithinPartitions("_own")
        return laid.drop("_own").mapInArrow(_unpack, schema)

    # --- ranking

    def search_batch(self, queries: DataFrame, query_id: str, query_text: str, k: int = SEARCH_LIMIT, where: Column | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): the best ``k`` documents for every question, optionally among those that satisfy ``where``."""
        lists, corpus = self.lists(), self.corpus()
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(word_array(query_text)).alias("term")).distinct()
        if lists is None:
            return asked.select("query_id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
        met = lists.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
        df = met.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(corpus.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(idf.alias("idf"), "term"))).alias("terms"))
        heads = lists.filter("term is null")
        if where is not None:
            allowed = self._read("documents").filter(where).select(F.col("doc_id").alias("_id"))
            places = heads.select("shard", F.posexplode("ids").alias("place", "_id")).join(allowed, "_id", "left_semi")
            heads = heads.drop("places").join(places.groupBy("shard").agg(F.sort_array(F.collect_list("place")).alias("allowed")), "shard")
        else:
            heads = heads.withColumn("allowed", F.lit(None).cast("array<int>"))
        # Questions travel in blocks, and a block goes to the shards that hold a list of one of its terms.
        blocks = max(1, -(-asked.select("query_id").distinct().count() // BLOCK_QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
        packed = weighted.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("query_id", "terms")).alias("questions"))
        visits = asked.select(block, "term").distinct().join(met.select("shard", "term"), "term").select("block", "shard").distinct()
        copies = visits.join(packed, "block").select("shard", "questions")
        work = (
            heads.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("places"), "counts", "most", "shortest", "ids", "allowed")
            .unionByName(met.withColumns({"kind": F.lit(1), "allowed": F.lit(None).cast("array<int>")}).select("shard", "kind", "term", "places", "counts", "most", "shortest", "ids", "allowed"))
            .withColumn("questions", F.lit(None).cast(copies.schema["questions"].dataType))
        )
        nothing = [F.lit(None).cast(work.schema[c].dataType).alias(c) for c in ("term", "places", "counts", "most", "shortest", "ids", "allowed")]
        work = work.unionByName(copies.select("shard", F.lit(2).alias("kind"), *nothing, "questions"))
        work = work.repartition("shard").sortWithinPartitions("shard", "kind")
        schema = T.StructType([asked.schema["query_id"], T.StructField("doc_id", lists.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
        found = work.mapInArrow(_ranked(k, corpus.mean, ["query_id", "doc_id", "score"]), schema)
        top = top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, rank="rank")
        return top.select("query_id", "rank", "doc_id", "score")


def _total(column: str) -> Column:
    @F.arrow_udf("bigint")
    def total(blobs: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(x, np.int32).sum()) for x in blobs.to_pylist()], pa.int64())

    return total(column)


def _numbers(blobs: pa.Array) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other."""
    _, at, data = blobs.buffers()
    wide = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    ends = np.frombuffer(at, wide, len(blobs) + 1, blobs.offset * np.dtype(wide).itemsize)
    return np.frombuffer(data, np.int32, (ends[-1] - ends[0]) // 4, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, np.int32)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the documents of a shard before its lists; shards whose names share a hash may come mixed. Postings leave many at a time, not list by list."""
    heads, open_to_heads = {}, True
    for batch in batches:
        shard, term, places, counts, ids = (batch.column(i) for i in range(5))
        held = pc.is_null(term).to_numpy(zero_copy_only=False)
        codes = shard.dictionary_encode()
        names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        # Runs of rows of one shard and kind.
        starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | held[1:] | held[:-1]])) if len(batch) else []
        for low, high in zip(starts, [*starts[1:], len(batch)], strict=True):
            name = names[code[low]]
            if held[low]:
                if not open_to_heads:
                    heads, open_to_heads = {}, True
                heads[name] = (ids[low].values, np.frombuffer(counts[low].as_py(), np.int32))
                continue
            open_to_heads = False
            of, lengths = heads[name]
            some = counts.slice(low, high - low)
            at, tf = _numbers(places.slice(low, high - low)), _numbers(some)
            row = np.repeat(np.arange(low, high), pc.binary_length(some).to_numpy() // 4)
            for first in range(0, len(at), UNPACKED_ROWS):
                piece = slice(first, first + UNPACKED_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [of.take(pa.array(at[piece])), term.take(pa.array(row[piece])), pa.array(tf[piece].astype(np.int64)), pa.array(lengths[at[piece]].astype(np.int64))],
                    ["doc_id", "term", "tf", "length"],
                )


class ShardLists:
    """The lists of a shard that some questions ask for."""

    def __init__(self, lengths: np.ndarray, mean: float, allowed: np.ndarray | None):
        self.norm = K1 * (1 - B + B * lengths / mean)
        self.mean, self.allowed = mean, allowed
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}
        self.looked_at = 0

    def add(self, term: str, places: np.ndarray, counts: np.ndarray, most: int, shortest: int) -> None:
        bound = most * (K1 + 1) / (most + K1 * (1 - B + B * shortest / self.mean))
        self.lists[term] = (places, counts, bound)

    def _weights(self, idf: float, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return idf * (counts * (K1 + 1) / (counts + self.norm[places]))

    def best(self, terms: Sequence[tuple[float, str]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that may be among the best ``k``; ``terms``: (idf, term)."""
        own = sorted(((idf * self.lists[t][2], idf, t) for idf, t in terms if t in self.lists), key=lambda x: (-x[0], x[2]))
        left = np.concatenate([np.cumsum([b for b, _, _ in own][::-1])[::-1], [0.0]])
        score = np.zeros(len(self.norm))
        open_to = np.ones(len(self.norm), bool) if self.allowed is None else self.allowed
        at = 0
        kth = 0.0
        while at < len(own):
            _, idf, term = own[at]
            places, counts, _ = self.lists[term]
            score[places] += self._weights(idf, places, counts)
            self.looked_at += len(places)
            at += 1
            seen = score[open_to]
            if len(seen) > k:
                kth = np.partition(seen, len(seen) - k)[len(seen) - k]
            if left[at] < kth - _ROUNDING:  # documents without any term so far can't get there
                break
        some = np.flatnonzero(open_to & (score > 0) & (score + left[at] >= kth - _ROUNDING))
        for _, idf, term in own[at:]:
            places, counts, _ = self.lists[term]
            found = np.searchsorted(places, some)
            found[found == len(places)] = 0
            hit = places[found] == some
            score[some[hit]] += self._weights(idf, some[hit], counts[found[hit]])
            self.looked_at += len(some)
        return some, np.round(score[some], SCORE_DIGITS)


def _ranked(k: int, mean: float, names: list[str]):
    """Rows sorted by (shard, kind): documents, lists, blocks of questions; the ``k`` best of the shard for each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, ids, order = None, None, None, None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for row, (name, kind) in enumerate(zip(column["shard"].to_pylist(), column["kind"].to_pylist(), strict=True)):
                if kind == 0:
                    now, ids = name, column["ids"][row].values
                    order = np.empty(len(ids), np.int64)
                    order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    lengths = np.frombuffer(column["counts"][row].as_py(), np.int32)
                    allowed = None
                    if column["allowed"][row].is_valid:
                        allowed = np.zeros(len(ids), bool)
                        allowed[column["allowed"][row].values.to_numpy()] = True
                    shard = ShardLists(lengths, mean, allowed)
                elif name != now:
                    continue  # a shard none of whose documents is allowed
                elif kind == 1:
                    places, counts = (np.frombuffer(column[c][row].as_py(), np.int32) for c in ("places", "counts"))
                    shard.add(column["term"][row].as_py(), places, counts, column["most"][row].as_py(), column["shortest"][row].as_py())
                else:
                    asked, hits, scores = [], [], []
                    questions = column["questions"][row].values
                    of = questions.field("query_id")
                    for q, terms in enumerate(questions.field("terms").to_pylist()):
                        places, score = shard.best([(t["idf"], t["term"]) for t in terms], k)
                        first = np.lexsort((order[places], -score))[:k]
                        asked += [q] * len(first)
                        hits.append(places[first])
                        scores.append(score[first])
                    if asked:
                        yield pa.RecordBatch.from_arrays(
                            [of.take(pa.array(asked)), ids.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(scores))], names
                        )

    return run
