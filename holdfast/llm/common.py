"""What the operators share: words, shared tables, seeded numbers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.sources.workspace import fresh_dir

# Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once below the shared folder and read back: a lost executor re-reads, never re-derives."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(spark: SparkSession, rows: Sequence[Sequence], schema: pa.Schema) -> DataFrame:
    """Rows that the driver holds, sent as Arrow: a list would start Python workers of another kind, which stay beside the operators' own."""
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator works on, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def in_slices(column: pa.Array, rows: int = 200) -> Iterator:
    """The values of an Arrow column, some rows at a time, so that only these are Python objects."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8; null is the empty text."""
    return (t or b"" for t in in_slices(column.cast(pa.binary())))


def some_texts(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts): the texts of an Arrow column as UTF-8, about ``size`` bytes at a time."""
    some, held, first = [], 0, 0
    for text in utf8(column):
        some.append(text)
        held += len(text)
        if held >= size:
            yield first, some
            first, some, held = first + len(some), [], 0
    if some:
        yield first, some


def release_memory() -> None:
    """Hand freed memory back to the system, so that a reused worker doesn't keep the peak of the task before."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, handing back its memory at the end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def seeded(seed: int, *columns: str | Column) -> Column:
    """A number below 2**60 that depends on the seed and the columns only; SQL engines with md5 can repeat it."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


class WordHash(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` words; empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out = mix(out + _MIX) + words[k : k + count]
    return mix(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True
_SPACED = np.where(_IS_SPACE, 32, np.arange(256)).astype(np.uint8)
# The bytes that count in the last eight of a word, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64


class TextWords(NamedTuple):
    """The words of some texts, one after the other."""

    hashes: np.ndarray
    bounds: np.ndarray  # of text i, the words from bounds[i] to bounds[i + 1]
    places: np.ndarray  # of word k, the bytes of ``spaced`` from places[k] on
    spaced: bytes  # the words, a space behind each

    def runs(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words from each ``first`` to before its ``end``, joined by one space."""
        return [self.spaced[a:b] for a, b in zip(self.places[first].tolist(), (self.places[end] - 1).tolist(), strict=True)]


def text_words(texts: Sequence[bytes]) -> TextWords:
    """Words and their 64-bit hashes, without an object for each: eight bytes of all words are hashed at a time, long words by xxh3."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    word = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    word[ends[ends < len(data)]] = True  # the white space behind each word stays, as a space
    spaced = _SPACED[data[word]].tobytes()
    lengths = ends - begins
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    eights = np.ndarray((len(spaced) + 1,), np.uint64, spaced + bytes(8), strides=(1,))
    hashes = lengths.astype(np.uint64)
    short = np.flatnonzero(lengths <= LONG_WORD)
    at, left = places[short], lengths[short]
    for _ in range(0, LONG_WORD, 8):
        hashes[short] = mix(hashes[short] + _MIX) + (eights[at] & _LOW[np.minimum(left, 8)])
        more = left > 8
        if not more.any():
            break
        short, at, left = short[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(lengths > LONG_WORD)
    hashes[long] = [xxhash.xxh3_64_intdigest(w) for w in TextWords(hashes, bounds, places, spaced).runs(long, long + 1)]
    return TextWords(mix(hashes), bounds, places, spaced)


# Offsets of this many runs are sent to every task; more of them are joined by a shuffle.
SENT_OFFSETS = 100_000


def with_positions(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` with ``pos``, their place 0, 1, ... in ``order`` within their ``group``, and ``n``, the rows of the group.

    Range partitions of (group, order) are sorted and written once, so a group of any size falls into many tasks and a
    lost one changes no place. Only one row for each group in a partition is counted further. ``order`` must decide ties.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(runs.select("_part", group, "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("n")), label + "-offsets")
    if offsets.count() <= SENT_OFFSETS:
        offsets = F.broadcast(offsets)
    pos = F.col("_at") - F.col("_first") + F.col("_before")
    return placed.join(offsets, ["_part", group]).withColumn("pos", pos).drop("_part", "_at", "_first", "_before")
