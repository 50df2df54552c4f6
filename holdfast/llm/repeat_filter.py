"""Bloom filters that Spark builds from a table: which hashes may occur twice, which keys may be in a set.

A filter has at most ``MOST_BITS`` bits, so what is broadcast never exceeds 128 MB. Tables with more rows than
the bits were meant for only get more false positives: more rows take the slower way, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import tidy

MOST_BITS = 1 << 30
BITS_PER_ROW = 16
_CHUNK_BITS = 20
_FLUSH = 4_000_000


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """A power of two with about ``bits_per_row`` bits a row, within fixed bounds."""
    return min(MOST_BITS, max(1 << _CHUNK_BITS, 1 << (max(rows, 1) * bits_per_row - 1).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit hash, as rows of two."""
    second = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.stack([hashes & np.uint64(bits - 1), second & np.uint64(bits - 1)], axis=1)


def _hashes_of(batch: pa.RecordBatch) -> np.ndarray:
    """The one BIGINT column of a batch."""
    return batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)


def _positions_of_partition(bits: int, read: Callable):
    def emit(positions: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(positions)
        positions.clear()
        every.sort()
        new = np.append(True, every[1:] != every[:-1])
        at, again = every[new], np.append(~new[1:], False)[new]  # again: the next one is the same
        del every, new
        cuts = np.flatnonzero(np.diff(at >> np.uint32(_CHUNK_BITS))) + 1
        names, once, twice = [], [], []
        for part, more in zip(np.split(at, cuts), np.split(again, cuts), strict=True):
            low = part & np.uint32((1 << _CHUNK_BITS) - 1)
            names.append(int(part[0]) >> _CHUNK_BITS)
            once.append(low[~more].tobytes())
            twice.append(low[more].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["chunk", "once", "twice"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for hashes in read(batch):
                both = _positions(hashes, bits)
                both[both[:, 0] == both[:, 1], 1] ^= np.uint64(1)  # else one hash would count twice at one position
                held.append(both.astype(np.uint32).ravel())  # MOST_BITS fits, and sorting takes half the memory
                n += both.size
                if n >= _FLUSH:
                    yield from emit(held)
                    held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _merge_chunks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk not in seen:
                    seen[chunk] = (np.zeros(1 << _CHUNK_BITS, bool), np.zeros(1 << _CHUNK_BITS, bool))
                first, again = seen[chunk]
                a, b = np.frombuffer(once, np.uint32), np.frombuffer(twice, np.uint32)
                again[b] = True
                again[a] |= first[a]
                first[a] = True
                again[b] = True
                first[b] = True
        for chunk, (first, again) in seen.items():
            kept = np.packbits(again if least > 1 else first, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kept], pa.binary())], ["chunk", "bits"])

    return run


class HashFilter:
    """Membership test for 64-bit hashes; shipped to the tasks as one broadcast of at most 128 MB."""

    def __init__(self, spark, bits: int, data: np.ndarray):
        self.bits, self._data = bits, spark.sparkContext.broadcast(data)

    def __getstate__(self):
        return {"bits": self.bits, "_data": self._data}

    def release(self) -> None:
        """Free the copies on the executors; what still needs the filter fetches it again."""
        self._data.unpersist()

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """True where the hash may be in the set; never False for one that is."""
        both, data = _positions(hashes, self.bits), self._data.value
        both[both[:, 0] == both[:, 1], 1] ^= np.uint64(1)
        hit = np.ones(len(hashes), bool)
        for at in both.T:
            hit &= (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return hit


def build(
    hashes: DataFrame,
    rows: int,
    least: int,
    read: Callable[[pa.RecordBatch], Iterable[np.ndarray]] | None = None,
    bits_per_row: int = BITS_PER_ROW,
) -> HashFilter:
    """A filter over the one BIGINT column of ``hashes``: those that occur at least ``least`` (1 or 2) times.

    ``read`` takes the hashes out of a batch of other rows, so that they needn't be rows themselves.

    Each task sends the bit positions it met, four bytes each, to the task that merges their
    chunk of the filter. Only the merged filter reaches the driver, at most 128 MB.
    """
    bits = filter_bits(rows, bits_per_row)
    parts = hashes.mapInArrow(tidy(_positions_of_partition(bits, read or (lambda batch: [_hashes_of(batch)]))), "chunk bigint, once binary, twice binary")
    merged = parts.repartition("chunk").mapInArrow(tidy(_merge_chunks(least)), "chunk bigint, bits binary")
    data = np.zeros(bits // 8, np.uint8)
    width = (1 << _CHUNK_BITS) // 8
    for row in merged.collect():
        data[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return HashFilter(hashes.sparkSession, bits, data)
