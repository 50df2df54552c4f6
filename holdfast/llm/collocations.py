"""Phrase collocations, counted level by level with tries of the phrases that can still be frequent.

Texts are cut into pieces and words once and stored as 64-bit symbols of (language, word). Words are counted in that pass.
A phrase of k words can only be frequent if its first and its last k - 1 words are, and if the bucket that its hash
falls into was met often enough; what passes both tests in the stored symbols is a candidate, so none is missed. Candidates are dealt
by hash to shards of bounded size; each shard becomes a double-array trie. Some tries at a time are broadcast, every task advances the
states of all its text positions through them, level by level, and counts the accepting states; the counts of the tasks are summed by shard.
More candidates make more shards and passes over the symbols, never larger tries.

A frequent phrase stands in many tasks, so not all of them send their candidates: first some files of the stored symbols do, in rounds of
doubled size, and in each round only what a filter of the rounds before doesn't know. These candidates are dealt to tries. While they are counted, each
candidate that no trie accepts is sent out; these come into tries of their own and are counted next, so what a filter mistook isn't lost.

Symbols are hashes; if two of the corpus' words share one, all is done again with another seed, so counts are exact.
Scores are whole numbers computed in 38-digit decimals, exact for corpora of up to 10^16 words.

Cases: a null text has no words; a null language is ``und``; a language without words gives no row; texts of any length are read whole, in
slices that never split a phrase; ties in score and frequency go by the phrase's bytes; repeated rows count each time; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm import repeat_filter
from holdfast.llm.common import ngram_hashes, stored, tidy, utf8, with_positions
from holdfast.llm.double_array import DoubleArray
from holdfast.operators.skew import join_to_unique

# Phrases of a trie, and tries that are broadcast together: at most about 50 MB.
TRIE_PHRASES = 1 << 16
TRIES_A_PASS = 8
# One in so many files takes part in the first rounds of candidates.
FIRST_SHARE = 8
# Phrases of a shard whose counts are summed together.
PART_PHRASES = 1 << 13
# Words of a stored row, words looked at together, hashes and distinct words that a task holds before it hands them on.
ROW_WORDS = 1 << 15
SLICE_WORDS = 1 << 18
FLUSH_HASHES = 1 << 21
FLUSH_DISTINCT = 150_000
_CHUNK_BITS = 20
_U = np.uint64
# The characters that end a piece, all written as a full stop, and the tab as a space.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")


class _Words(dict):
    """Numbers for the words of one language, in the order they are met; 0 is the end of a piece."""

    def __init__(self, lang: str, seed: int, bits: int):
        super().__init__({b".": 0})
        self.names, self.lang, self.counts = [b"."], lang, np.zeros(1, np.int64)
        self._seed = xxhash.xxh3_64_intdigest(f"{seed}:{lang}")
        self._table, self._new = np.zeros(1, _U), []
        self._mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self._new.append(xxhash.xxh3_64_intdigest(word, self._seed) & self._mask or 1)
        return number

    def symbols(self) -> np.ndarray:
        if self._new:
            self._table, self._new = np.concatenate([self._table, np.array(self._new, _U)]), []
        return self._table

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number the words and count them."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        now = np.bincount(out, minlength=len(self.names))
        now[: len(self.counts)] += self.counts
        self.counts = now
        return out


def _pieces_in_rows(numbers: np.ndarray) -> Iterator[np.ndarray]:
    """Cut at ends of pieces, after about ``ROW_WORDS`` words each."""
    ends, at = np.flatnonzero(numbers == 0), 0
    while at < len(numbers):
        after = int(np.searchsorted(ends, at + ROW_WORDS))
        end = int(ends[after]) + 1 if after < len(ends) else len(numbers)
        yield numbers[at:end]
        at = end


_ENCODED = "lang string, word string, symbol bigint, times bigint, symbols binary"
_ENCODED_NAMES = ["lang", "word", "symbol", "times", "symbols"]


def _encode(seed: int, bits: int):
    """Rows with the symbols of some texts, 0 between pieces, and rows with words and how often a task met them."""

    def text_rows(numbers: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
        blobs = [symbols[part].tobytes() for part in _pieces_in_rows(numbers)]
        none = [pa.nulls(len(blobs), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(blobs, pa.binary())], _ENCODED_NAMES)

    def word_rows(words: _Words) -> pa.RecordBatch:
        size = len(words.names) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words.lang] * size, pa.string()),
                pa.array([w.decode() for w in words.names[1:]], pa.string()),
                pa.array(words.symbols()[1:].view(np.int64)),
                pa.array(words.counts[1:]),
                pa.nulls(size, pa.binary()),
            ],
            _ENCODED_NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}

        def encoded(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            words = known[lang] if lang in known else known.setdefault(lang, _Words(lang, seed, bits))
            numbers = words.numbers(b".".join(texts).lower().translate(_ENDS).replace(b".", b" . ").split())
            yield text_rows(numbers, words.symbols())
            if sum(len(w.names) for w in known.values()) > FLUSH_DISTINCT:
                for full in [*known]:
                    yield word_rows(known.pop(full))

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text)
                    if sizes[lang] > 1_000_000:
                        yield from encoded(lang, by_lang.pop(lang))
                        sizes[lang] = 0
            for lang, texts in by_lang.items():
                yield from encoded(lang, texts)
        for words in known.values():
            yield word_rows(words)

    return run


class _Marks:
    """One bit for each bucket of phrase hashes: was it met often enough? Broadcast, at most 128 MB."""

    def __init__(self, spark, bits: int, data: np.ndarray):
        self.bits, self.sent = bits, spark.sparkContext.broadcast(data)

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = keys & _U(self.bits - 1)
        return (self.sent.value[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) == 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The stored symbols, a few rows at a time; a break stands between rows."""
    held, n = [], 0
    for batch in batches:
        for blob in batch.column(0):
            symbols = np.frombuffer(blob.as_buffer(), _U)
            held += [symbols, np.zeros(1, _U)]
            n += len(symbols) + 1
            if n >= SLICE_WORDS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _whole(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` words follow within a piece."""
    count = len(symbols) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    word = symbols != 0
    whole = word[:count].copy()
    for k in range(1, length):
        whole &= word[k : k + count]
    return np.flatnonzero(whole)


def _hopeful(symbols: np.ndarray, length: int, shorter: repeat_filter.HashFilter | None, marks: _Marks | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the phrases of ``length`` words that may be frequent: both parts of
    ``length - 1`` words pass the filter, if there is one, and the phrase's bucket is marked."""
    at = _whole(symbols, length)
    keys = ngram_hashes(symbols, length)[at] if len(at) else np.zeros(0, _U)
    if marks is not None:
        good = marks.test(keys)
        at, keys = at[good], keys[good]
    if not len(at) or shorter is None:
        return at, keys
    part = symbols if length == 2 else ngram_hashes(symbols, length - 1)
    good = shorter.test(part[at])
    at, keys = at[good], keys[good]
    good = shorter.test(part[at + 1])
    return at[good], keys[good]


def _bucket_counts(length: int, shorter: repeat_filter.HashFilter, bits: int):
    """(chunk, low, times): how often each bucket was met, cut into chunks of the bucket numbers."""

    def counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        bucket, times = np.unique(np.concatenate(hashes) & _U(bits - 1), return_counts=True)
        chunk = (bucket >> _U(_CHUNK_BITS)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]]).tolist()
        low = (bucket & _U((1 << _CHUNK_BITS) - 1)).astype(np.uint32)
        times = np.minimum(times, 255).astype(np.uint8)
        spans = [*zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(chunk[i]) for i, _ in spans], pa.int64()),
                pa.array([low[i:j].tobytes() for i, j in spans], pa.binary()),
                pa.array([times[i:j].tobytes() for i, j in spans], pa.binary()),
            ],
            ["chunk", "low", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for symbols in _slices(batches):
            _, keys = _hopeful(symbols, length, shorter)
            held.append(keys)
            n += len(keys)
            if n >= FLUSH_HASHES:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    return run


def _merge_buckets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, low, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = seen.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, np.uint8))
                at = np.frombuffer(low, np.uint32)
                counts[at] = np.minimum(counts[at].astype(np.uint16) + np.frombuffer(times, np.uint8), 255).astype(np.uint8)
        for chunk, counts in seen.items():
            bits = np.packbits(counts >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bits], pa.binary())], ["chunk", "bits"])

    return run


def _marks(texts: DataFrame, length: int, shorter: repeat_filter.HashFilter, words: int, least: int) -> _Marks:
    bits = min(repeat_filter.MOST_BITS, max(1 << _CHUNK_BITS, 1 << (2 * words).bit_length()))
    parts = texts.mapInArrow(tidy(_bucket_counts(length, shorter, bits)), "chunk bigint, low binary, times binary")
    data = np.zeros(bits // 8, np.uint8)
    width = (1 << _CHUNK_BITS) // 8
    for row in parts.repartition("chunk").mapInArrow(tidy(_merge_buckets(min(least, 255))), "chunk bigint, bits binary").collect():
        data[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return _Marks(texts.sparkSession, bits, data)


def _phrase_fields(length: int) -> list[str]:
    return [f"s{k}" for k in range(length)]


def _schema(length: int, *more: str) -> str:
    return ", ".join(["key bigint", *(f"{c} bigint" for c in _phrase_fields(length)), *more])


class _Distinct:
    """Phrases of some millions of words, once each."""

    def __init__(self, length: int):
        self._length, self._held, self._n = length, [], 0

    def __bool__(self) -> bool:
        return self._n > 0

    def add(self, symbols: np.ndarray, at: np.ndarray, keys: np.ndarray) -> bool:
        """Whether it is time to hand them on."""
        keys, first = _first_of_each(keys, symbols, at, self._length)
        self._held.append((np.stack([symbols[at[first] + k] for k in range(self._length)], axis=1), keys))
        self._n += len(keys)
        return self._n >= FLUSH_HASHES // 4

    def columns(self) -> list[pa.Array]:
        """key, s0, ...; nothing is held afterwards."""
        phrases = np.concatenate([p for p, _ in self._held])
        keys, first, which = np.unique(np.concatenate([k for _, k in self._held]), return_index=True, return_inverse=True)
        other = (phrases != phrases[first][which]).any(axis=1)  # equal hashes of different phrases
        rows = np.concatenate([phrases[first], phrases[other]])
        keys = np.concatenate([keys, keys[which[other]]])
        self._held, self._n = [], 0
        return [pa.array(c.view(np.int64)) for c in (keys, *map(np.ascontiguousarray, rows.T))]


def _candidate_rows(length: int, shorter: repeat_filter.HashFilter, marks: _Marks, known: repeat_filter.HashFilter | None):
    """The phrases that can be frequent, but for known ones, once for each of some millions of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, names = _Distinct(length), ["key", *_phrase_fields(length)]
        for symbols in _slices(batches):
            at, keys = _hopeful(symbols, length, shorter, marks)
            if known is not None:
                new = ~known.test(keys)
                at, keys = at[new], keys[new]
            if met.add(symbols, at, keys):
                yield pa.RecordBatch.from_arrays(met.columns(), names)
        if met:
            yield pa.RecordBatch.from_arrays(met.columns(), names)

    return run


def _first_of_each(keys: np.ndarray, symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys without repetition and where they stand; phrases that share a key with another one all stay."""
    unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
    other = np.zeros(len(at), bool)
    for k in range(length):
        other |= symbols[at + k] != symbols[at[first][which] + k]
    more = np.flatnonzero(other)
    return np.concatenate([unique, keys[more]]), np.concatenate([first, more])


_TRIE = "shard int, symbols binary, base binary, checks binary, leaves binary, phrase binary, phrases binary"
_TRIE_NAMES = ["shard", "symbols", "base", "checks", "leaves", "phrase", "phrases"]


def _build_tries(length: int):
    """Rows (shard, s0, s1, ...) that stand together by shard to one trie each."""

    def trie(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
        phrases = np.concatenate(held).view(_U)
        made = DoubleArray.of(phrases)
        parts = (made.symbols, made.base, made.check, made.leaves, made.phrase, phrases)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], _TRIE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            rows = np.stack([batch.column(1 + k).to_numpy() for k in range(length)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != now:
                    if held:
                        yield trie(now, held)
                    now, held = int(shards[lo]), []
                held.append(rows[lo:hi])
        if held:
            yield trie(now, held)

    return run


def _count_states(length: int, sent, shards: int, mine: range, shorter: repeat_filter.HashFilter, marks: _Marks, others: bool):
    """Accepting states of the candidates of the shards ``mine``: (shard, part, places, times), once a task.

    With ``others`` the phrases of candidates that no trie accepts, too: (key, s0, ...).
    """
    names = ["shard", "part", "places", "times", "key", *_phrase_fields(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {s: DoubleArray(length, *(np.frombuffer(x, kind) for x, kind in zip(parts, (_U, *[np.int32] * 4), strict=True))) for s, parts in sent.value}
        counts = {s: np.zeros(int(t.phrase.max()) + 1, np.int64) for s, t in tries.items()}
        left = _Distinct(length)

        def left_rows() -> pa.RecordBatch:
            columns = left.columns()
            none = [pa.nulls(len(columns[0]), t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, *columns], names)

        for symbols in _slices(batches):
            at, keys = _hopeful(symbols, length, shorter if others else None, marks)
            shard = np.mod(keys.view(np.int64), shards)
            here = (shard >= mine.start) & (shard < mine.stop)
            at, keys, shard = at[here], keys[here], shard[here]
            known = np.zeros(len(at), bool)
            for s, trie in tries.items():
                of = np.flatnonzero(shard == s)
                met, phrase = trie.walk(symbols, at[of])
                counts[s] += np.bincount(phrase, minlength=len(counts[s]))
                known[of[met]] = True
            if others and left.add(symbols, at[~known], keys[~known]):
                yield left_rows()
        if left:
            yield left_rows()
        for s, times in counts.items():
            parts = [(p, part, np.flatnonzero(part)) for p, part in enumerate(np.split(times, range(PART_PHRASES, len(times), PART_PHRASES)))]
            parts = [x for x in parts if len(x[2])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s] * len(parts), pa.int32()),
                    pa.array([p for p, _, _ in parts], pa.int32()),
                    pa.array([met.astype(np.int32).tobytes() for _, _, met in parts], pa.binary()),
                    pa.array([part[met].tobytes() for _, part, met in parts], pa.binary()),
                    *[pa.nulls(len(parts), pa.int64())] * (1 + length),
                ],
                names,
            )

    return run


def _phrase_parts(length: int):
    """(shard, part, phrases): the phrases of each trie in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = PART_PHRASES * length * 8
        for batch in batches:
            for shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [blob[i : i + width] for i in range(0, len(blob), width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                    ["shard", "part", "phrases"],
                )

    return run


def _sum_parts(length: int, least: int):
    """Rows (shard, part, phrases, places, times), the phrases of a part first, to its frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, total = None, None, None

        def frequent() -> Iterator[pa.RecordBatch]:
            if phrases is not None:
                good = np.flatnonzero(total >= least)
                rows = phrases[good]
                columns = [c.view(np.int64) for c in (_row_hashes(rows), *map(np.ascontiguousarray, rows.T))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(total[good])], ["key", *_phrase_fields(length), "f"])

        for batch in batches:
            for shard, part, blob, places, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob is not None:
                    yield from frequent()
                    now, phrases = (shard, part), np.frombuffer(blob, _U).reshape(-1, length)
                    total = np.zeros(len(phrases), np.int64)
                elif (shard, part) == now:
                    total[np.frombuffer(places, np.int32)] += np.frombuffer(times, np.int64)
        yield from frequent()

    return run


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """The hash of each phrase, as :func:`ngram_hashes` gives it in a text."""
    if not len(rows):
        return np.zeros(0, _U)
    length = rows.shape[1]
    return ngram_hashes(rows.reshape(-1), length)[::length]


def _frequent(texts: DataFrame, length: int, shorter: repeat_filter.HashFilter, words: int, least: int) -> DataFrame:
    """(key, s0, ..., f) of all phrases of ``length`` words met at least ``least`` times."""
    marks = _marks(texts, length, shorter, words, least)
    found, others = _counted(texts, _first_candidates(texts, length, shorter, marks), length, shorter, marks, least, True)
    if not others.isEmpty():
        found = found.unionByName(_counted(texts, _once(others, length), length, shorter, marks, least, False)[0])
    marks.sent.unpersist()
    return found


def _once(rows: DataFrame, length: int) -> DataFrame:
    return stored(rows.dropDuplicates(["key", *_phrase_fields(length)]), "phrases-candidates")


def _first_candidates(texts: DataFrame, length: int, shorter: repeat_filter.HashFilter, marks: _Marks) -> DataFrame:
    """The candidates of one in ``FIRST_SHARE`` files, but for some that a filter mistakes for others."""
    files = sorted(f.rsplit("/", 1)[-1] for f in texts.inputFiles())[::FIRST_SHARE]
    found, known, low = None, None, 0
    while found is None or low < len(files):
        high = max(2 * low, 1)
        some = texts.filter(F.col("_metadata.file_name").isin(files[low:high]))
        new = _once(some.mapInArrow(tidy(_candidate_rows(length, shorter, marks, known)), _schema(length)), length)
        found, low = new if found is None else found.unionByName(new), high
        if known is not None:
            known.release()
        if low < len(files):
            known = repeat_filter.build(found.select(F.col("key").alias("h")), found.count(), least=1)
    return found


def _counted(
    texts: DataFrame, candidates: DataFrame, length: int, shorter: repeat_filter.HashFilter, marks: _Marks, least: int, others: bool
) -> tuple[DataFrame, DataFrame]:
    """(key, s0, ..., f) of those ``candidates`` that are frequent, and with ``others`` rows of all other candidates."""
    spark = texts.sparkSession
    shards = max(1, -(-candidates.count() // TRIE_PHRASES))
    dealt = candidates.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), *_phrase_fields(length))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    tries = stored(dealt.mapInArrow(tidy(_build_tries(length)), _TRIE), "phrases-tries")
    counted = []
    for low in range(0, shards, TRIES_A_PASS):
        mine = range(low, low + TRIES_A_PASS)
        some = tries.filter(F.col("shard").between(mine[0], mine[-1])).select(*_TRIE_NAMES[:-1]).toArrow()
        sent = spark.sparkContext.broadcast([(r[0], tuple(r[1:])) for r in zip(*(c.to_pylist() for c in some.columns), strict=True)])
        del some
        counts = texts.mapInArrow(tidy(_count_states(length, sent, shards, mine, shorter, marks, others)), "shard int, part int, places binary, times binary, " + _schema(length))
        counted.append(stored(counts, "phrases-counts"))
        sent.destroy()
    nothing = F.lit(None).cast("binary")
    parts = tries.select("shard", "phrases").mapInArrow(_phrase_parts(length), "shard int, part int, phrases binary")
    together = parts.select("shard", "part", F.lit(0).alias("kind"), "phrases", nothing.alias("places"), nothing.alias("times"))
    for counts in counted:
        met = counts.filter("shard is not null")
        together = together.unionByName(met.select("shard", "part", F.lit(1).alias("kind"), nothing.alias("phrases"), "places", "times"))
    together = together.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    summed = together.select("shard", "part", "phrases", "places", "times").mapInArrow(tidy(_sum_parts(length, least)), _schema(length, "f bigint"))
    left = [counts.filter("key is not null").select("key", *_phrase_fields(length)) for counts in counted]
    return stored(summed, "phrases-frequent"), functools.reduce(DataFrame.unionByName, left)


def _encoded_words(docs: DataFrame, text_col: str, lang_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """The stored symbols, and (lang, word, symbol, f) of all words; no two words share a symbol."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    seed = 0
    while True:
        encoded = stored(rows.mapInArrow(tidy(_encode(seed, bits)), _ENCODED), "phrases-symbols")
        words = encoded.filter("word is not null").groupBy("lang", "word").agg(F.min("symbol").alias("symbol"), F.sum("times").alias("f"))
        words = stored(words, "phrases-words")
        sizes = words.agg(F.count(F.lit(1)).alias("words"), F.count_distinct("symbol").alias("symbols")).first()
        if sizes["words"] == sizes["symbols"]:
            return encoded.filter("symbols is not null").select("symbols"), words
        seed += 1


def _parts(rows: DataFrame, first: int, length: int, tables: dict[int, DataFrame], name: str) -> DataFrame:
    """``rows`` with the frequency of the ``length`` words from ``first`` on."""
    if length == 1:
        by = f"s{first}"
        one = tables[1].select(F.col("symbol").alias(by), F.col("f").alias(name))
        return join_to_unique(rows, one, by, ["key"], "inner")
    names = [F.col(f"s{k}").alias(f"s{first + k}") for k in range(length)]
    return rows.join(tables[length].select(*names, F.col("f").alias(name)), [f"s{first + k}" for k in range(length)])


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), in whole numbers."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) as decimal(31,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


def _scored(tables: dict[int, DataFrame], length: int, longest: int, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of one length that no longer candidate contains often enough."""
    rows = tables[length].withColumnRenamed("f", "a")
    keys = _phrase_fields(length)
    within = None
    for longer in range(length + 1, longest + 1):
        for first in range(longer - length + 1):
            some = tables[longer].select(*(F.col(f"s{first + k}").alias(f"s{k}") for k in range(length)), F.col("f").alias("outer"))
            within = some if within is None else within.unionByName(some)
    if within is not None:
        rows = rows.join(within.groupBy(*keys).agg(F.max("outer").alias("outer")), keys, "left")
        rows = rows.filter(F.coalesce(100 * F.col("outer") < percent * F.col("a"), F.lit(True))).drop("outer")
    rows = stored(rows, "phrases-left")
    for cut in range(1, length):
        rows = _parts(_parts(rows, 0, cut, tables, f"l{cut}"), cut, length - cut, tables, f"r{cut}")
    cuts = [F.struct(_score("a", f"l{c}", f"r{c}").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, length)]
    rows = rows.withColumn("best", F.array_min(F.array(*cuts)))
    for k in range(length):
        word = tables[1].select(F.col("symbol").alias(f"s{k}"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 0 else []))
        rows = join_to_unique(rows, word, f"s{k}", ["key"], "inner")
    phrase = F.concat_ws(" ", *(F.col(f"w{k}") for k in range(length)))
    return rows.select("lang", phrase.alias("phrase"), "a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2_000, percent: int = 50, text_col: str = "text", lang_col: str = "lang", bits: int = 64
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to ``longest`` words of each language.

    ``bits``: of a symbol; fewer than 64 are for tests of what happens when words share one.
    """
    texts, words = _encoded_words(docs, text_col, lang_col, bits)
    tables = {1: stored(words.filter(F.col("f") >= least), "phrases-frequent")}
    per_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    for length in range(2, longest + 1):
        shorter = tables[length - 1].select(F.col("symbol" if length == 2 else "key").alias("h"))
        seen = repeat_filter.build(shorter, tables[length - 1].count(), least=1)
        tables[length] = _frequent(texts, length, seen, total, least)
        seen.release()
    found = None
    for length in range(2, longest + 1):
        some = _scored(tables, length, longest, percent)
        found = some if found is None else found.unionByName(some)
    found = stored(found, "phrases-scored")
    ranked = with_positions(found, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "phrases-ranked").drop("n")
    best = ranked.filter(F.col("pos") < top).withColumn("rank", F.col("pos") + 1)
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
