"""Repeated passages removed by suffix automata of reference shards.

A window is a row of consecutive words. Each window has an anchor, its word m-gram with the smallest hash: equal windows have equal
anchors. Counting anchors over all documents finds those that more than one document holds; a filter of them
makes a second pass over the texts send out only the segments around them. A segment goes to the shard of its anchor, so all documents
that share a window meet in one shard, and nothing is compared across shards.

Within a shard documents stream in the order of their ids. The segments of smaller ids are the reference: a suffix
automaton holds them, the matching statistics of the next document's segment run through it, and each span that
matches at least a window's length is removed. Content met before is recognised at once and doesn't grow the automaton.

Anchors with more than ``CROWDED`` segments (a passage that a large part of the documents holds) go another exact way: their
windows are counted one by one, with partial minima before the shuffle. The few windows that occur as often themselves are
sent to every task with the smallest id that holds them; the others, each with few rows, stream by window.

Cases: null and empty texts have no words; a document with fewer words than a window loses nothing; rows that share an id are one
document, which never removes its own windows; a null id is neither smaller nor larger than another, such rows lose nothing; an
empty table gives an empty result. Whole texts are read, in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import repeat_filter
from holdfast.llm.common import id_and_text, mix, ngram_hashes, some_texts, stored, text_words, utf8

WINDOW = 13
ANCHOR = 6
CROWDED = 1_000
_SLICE = 100_000
_U = np.uint64


class SuffixAutomaton:
    """All factors of the word rows added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, onward: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the shorter factors that also end after p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # known from another row
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest known factor that ends with it."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append(length)
        return out


def matched_spans(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """The words covered by matches of at least ``window`` words, as maximal spans."""
    out: list[tuple[int, int]] = []
    for end, length in enumerate(lengths, 1):
        if length >= window:
            if out and end - window <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - window, end))
    return out


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each row of ``width`` values, the place of its smallest; of equal ones the leftmost. Widths are doubled."""
    least, place, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        place = np.where(right, place[step:], place[:-step])
        span += step
    return place


def anchored_windows(words: np.ndarray, window: int, anchor: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first, last start) of each run of windows with one anchor; of equal hashes the leftmost is the anchor.

    ``bounds``: where the texts begin that ``words`` holds, and its end; a window lies in one text.
    """
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = ngram_hashes(words, anchor)
    width = window - anchor + 1
    places = np.empty(count, np.int64)
    for at in range(0, count, _SLICE):
        found = _leftmost_least(grams[at : min(count, at + _SLICE) + width - 1], width)
        places[at : at + len(found)] = found + at
    starts = np.arange(count)
    if bounds is not None:
        starts = np.flatnonzero(starts + window <= np.repeat(bounds[1:], np.diff(bounds))[:count])
        places = places[starts]
    change = np.diff(places, prepend=-1, append=-1) != 0
    first, last = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
    return grams[places[first]], starts[first], starts[last]


def _text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _owners(first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The text that each word is of."""
    return np.searchsorted(bounds, first, side="right") - 1


def _anchor_batches(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "doc_id"])

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, owners, held = [], [], 0
            for at, texts in some_texts(batch.column(1)):
                words = text_words(texts)
                found, first, _ = anchored_windows(words.hashes, window, anchor, words.bounds)
                keys.append(found)
                owners.append(ids[at + _owners(first, words.bounds)])
                held += len(found)
                if held > 200_000:
                    yield flush()
                    keys, owners, held = [], [], 0
            if held:
                yield flush()

    return run


def _segment_batches(window: int, anchor: int, shared: repeat_filter.HashFilter, crowded):
    """(key, doc_id, text_key, start, words): the segment of each shared anchor; of crowded ones each window, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = crowded.value

        def rows(key, doc_id, text_key, start, content) -> pa.RecordBatch:
            columns = [pa.array(key), pa.array(doc_id), pa.array(text_key), pa.array(start.astype(np.int32)), content]
            return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "text_key", "start", "words"])

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in some_texts(batch.column(1)):
                words = text_words(texts)
                keys, first, last = anchored_windows(words.hashes, window, anchor, words.bounds)
                hit = np.flatnonzero(shared.test(mix(keys)))
                keys, first, last = keys[hit].view(np.int64), first[hit], last[hit]
                owner = _owners(first, words.bounds)
                names = np.zeros(len(texts), np.int64)
                for i in np.unique(owner).tolist():
                    names[i] = _text_key(texts[i])
                dense = np.isin(keys, many)
                if dense.any():
                    sizes = last[dense] - first[dense] + 1
                    start = np.repeat(first[dense] + sizes - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
                    of = np.repeat(owner[dense], sizes)
                    whole = ngram_hashes(words.hashes, window).view(np.int64)
                    yield rows(whole[start], ids[at + of], names[of], start - words.bounds[of], pa.nulls(len(of), pa.binary()))
                if not dense.all():
                    key, first, last, of = (x[~dense] for x in (keys, first, last, owner))
                    yield rows(key, ids[at + of], names[of], first - words.bounds[of], pa.array(words.runs(first, last + window), pa.binary()))

    return run


def _shard_batches(window: int):
    """Segments sorted by (key, doc_id) to spans (doc_id, text_key, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "first", "last"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        key = current = None
        known: set[bytes] = set()  # contents of smaller ids
        fresh: list[bytes] = []  # of the current id
        waiting: list[bytes] = []  # known, but not yet in the automaton
        automaton: SuffixAutomaton | None = None
        rows: list[tuple] = []
        for batch in batches:
            for k, doc_id, text_key, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, current, known, fresh, waiting, automaton = k, doc_id, set(), [], [], None
                elif doc_id != current:
                    new = [c for c in dict.fromkeys(fresh) if c not in known]
                    known.update(new)
                    waiting += new
                    current, fresh = doc_id, []
                if content in known:
                    rows.append((doc_id, text_key, start, start + content.count(b" ") + 1))
                    continue
                if known:
                    automaton = automaton or SuffixAutomaton()
                    for row in waiting:
                        automaton.add(row.split(b" "))
                    waiting = []
                    spans = matched_spans(automaton.matches(content.split(b" ")), window)
                    rows += [(doc_id, text_key, start + a, start + b) for a, b in spans]
                fresh.append(content)
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, first, last): words that a smaller id's window covers, as spans that may overlap."""
    spark = texts.sparkSession
    anchors = texts.mapInArrow(_anchor_batches(window, anchor), "key bigint, doc_id bigint")
    counts = anchors.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = stored(counts.filter("low < high").select("key", "n"), "passage-anchors")
    total = shared.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).first()
    # So many anchors can't be more than 50,000, whatever the input.
    limit = max(CROWDED, (total["n"] or 0) // 50_000)
    many = shared.filter(F.col("n") > limit).select("key").toPandas()["key"].to_numpy(np.int64)
    crowded = spark.sparkContext.broadcast(np.sort(many))
    held = repeat_filter.build(shared.select("key").mapInArrow(_mixed_keys, "h bigint"), total["keys"], least=1)
    schema = "key bigint, doc_id bigint, text_key bigint, start int, words binary"
    segments = stored(texts.mapInArrow(_segment_batches(window, anchor, held, crowded), schema), "passage-segments")
    plain = segments.filter("words is not null").repartition("key").sortWithinPartitions("key", "doc_id")
    spans = plain.mapInArrow(_shard_batches(window), "doc_id bigint, text_key bigint, first int, last int")
    single = segments.filter("words is null").select("key", "doc_id", "text_key", "start")
    owners = single.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    owners = stored(owners.filter("owner < high").select("key", "owner", "n"), "passage-owners")
    # An anchor has at most window - anchor + 1 windows, so these are at most 50,000 times that many.
    often = owners.filter(F.col("n") > limit).select("key", "owner").toPandas().sort_values("key")
    often = spark.sparkContext.broadcast((often["key"].to_numpy(np.int64), often["owner"].to_numpy(np.int64)))
    again = owners.filter(F.col("n") <= limit).select("key")
    again = repeat_filter.build(again.mapInArrow(_mixed_keys, "h bigint"), owners.count(), least=1)
    spans_schema = "doc_id bigint, text_key bigint, first int, last int"
    common = single.mapInArrow(_common_batches(window, often), spans_schema)
    rare = single.mapInArrow(_rare_batches(often, again), single.schema).repartition("key").sortWithinPartitions("key", "doc_id")
    return spans.unionByName(common).unionByName(rare.mapInArrow(_later_batches(window), spans_schema))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _spans_of(doc_id: np.ndarray, text_key: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows as spans; of one text, those that follow each other are one."""
    follows = (np.diff(start) == 1) & (np.diff(doc_id) == 0) & (np.diff(text_key) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~follows])) if len(start) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(start)) - 1 if len(start) else first
    columns = [doc_id[first], text_key[first], start[first].astype(np.int32), (start[last] + window).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "text_key", "first", "last"])


def _found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is among the sorted ones, its place there)."""
    at = np.minimum(np.searchsorted(among, keys), max(len(among) - 1, 0))
    return (among[at] == keys if len(among) else np.zeros(len(keys), bool)), at


def _common_batches(window: int, often):
    """Single windows that occur often, in the order of their text, to spans: their owners are known to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owner = often.value
        for batch in batches:
            key, doc_id, text_key, start = _columns(batch)
            hit, at = _found(key, known)
            hit[hit] = doc_id[hit] > owner[at[hit]]
            yield _spans_of(doc_id[hit], text_key[hit], start[hit], window)

    return run


def _rare_batches(often, again: repeat_filter.HashFilter):
    """Single windows that may occur again, but not often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = often.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(again.test(mix(key.view(_U))) & ~_found(key, known)[0]))

    return run


def _later_batches(window: int):
    """Rows sorted by (key, doc_id) to the windows of all but the smallest id of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_owner = None, 0
        for batch in batches:
            key, doc_id, text_key, start = _columns(batch)
            if not len(key):
                continue
            begins = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
            owner = doc_id[begins].copy()
            if key[0] == last_key:
                owner[0] = last_owner
            last_key, last_owner = key[-1], owner[-1]
            later = doc_id > np.repeat(owner, np.diff(np.append(begins, len(key))))
            yield _spans_of(doc_id[later], text_key[later], start[later], window)

    return run


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy(zero_copy_only=False).view(_U)).view(np.int64))], ["h"])


def _row_hash(doc_id: int, text_key: int) -> np.ndarray:
    return mix(np.array([doc_id], np.int64).view(_U) ^ mix(np.array([text_key], np.int64).view(_U)))


def _mixed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(_U) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(mix(a ^ mix(b)).view(np.int64))], ["h"])


def _sort_out(touched: repeat_filter.HashFilter):
    """Rows that lose nothing with their result; the others with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                name = _text_key(text)
                if doc_id is not None and touched.test(_row_hash(doc_id, name))[0]:
                    rows.append((doc_id, name, None, None, text))
                else:
                    words = text.split()
                    rows.append((doc_id, name, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None))
            columns = [*zip(*rows, strict=True)] if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "n_words", "kept_sha256", "text"]
            )

    return run


def keep_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """(number of words, the words outside the spans)."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return len(words), [words[i] for i in np.flatnonzero(kept)]


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_kept", T.LongType()), T.StructField("kept", T.BinaryType())])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts.to_pylist(), firsts.to_pylist(), lasts.to_pylist(), strict=True):
        n, kept = keep_words(text, [*zip(a or (), b or (), strict=True)])
        out.append((n, len(kept), b" ".join(kept)))
    n, m, kept = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.binary())], ["n_words", "n_kept", "kept"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows that lose nothing, rows that may lose words): the first with n_words and kept_sha256, the second with a ``cut``
    of n_words, n_kept and the kept words joined by one space."""
    texts = id_and_text(docs, id_col, text_col)
    spans = stored(repeated_spans(texts, window, anchor), "passage-spans")
    hashed = spans.select("doc_id", "text_key").distinct().mapInArrow(_mixed_rows, "h bigint")
    touched = repeat_filter.build(hashed, texts.count(), least=1)
    schema = "doc_id bigint, text_key bigint, n_words bigint, kept_sha256 string, text binary"
    rows = stored(texts.mapInArrow(_sort_out(touched), schema), "passage-rows")
    by_row = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # within one text
    by_row = by_row.select("doc_id", "text_key", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"))
    losing = rows.filter("text is not null").drop("n_words", "kept_sha256").join(by_row, ["doc_id", "text_key"], "left")
    return rows.filter("text is null").drop("text"), losing.withColumn("cut", _cut("text", "firsts", "lasts")).select("doc_id", "text_key", "cut")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    whole, losing = remove_repeated(docs, window, id_col=id_col, text_col=text_col)
    cut = losing.select("doc_id", "cut.n_words", (F.col("cut.n_words") - F.col("cut.n_kept")).alias("n_removed"), F.sha2(F.col("cut.kept"), 256).alias("kept_sha256"))
    return whole.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256").unionByName(cut)
