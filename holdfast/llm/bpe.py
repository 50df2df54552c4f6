"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as its symbols. The leaves of a segment tree hold the rank of each adjacent pair; the root is the
lowest rank, the leftmost of equals. Merging it changes three leaves at most, each updated in logarithmic
time, until the root holds no mergeable pair. A pre-token of any length takes n log n steps.

The vocabulary file stays where it is and is read by each Python worker; only its path travels.

Cases: a null or empty text has no tokens and decodes to the empty text; the strings of special tokens in a text
become these tokens, as they do by default; repeated rows give repeated results and an empty table none;
very long texts are handled whole; runs and pre-tokens are remembered up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdfast.llm.common import id_and_text, release_memory, tidy, utf8

_NONE = 1 << 60
# Runs between white space, and pre-tokens, that a generation of a worker's memory holds; the bytes of text handled at a time.
REMEMBERED = 60_000
SLICE_BYTES = 1_000_000
# Short pre-tokens whose trees stand in arrays at a time.
TREES = 1 << 12


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class RankTree:
    """Leaves: rank of the pair that starts at a symbol. The root gives the leftmost of the lowest ranks."""

    def __init__(self, ranks: list[int]):
        self.width = 1 << max(len(ranks) - 1, 0).bit_length()
        # rank * width + place: one comparison orders by rank, then by place
        leaves = [r * self.width + i if r < _NONE else _NONE for i, r in enumerate(ranks)]
        self.node = [_NONE] * self.width + leaves + [_NONE] * (self.width - len(leaves))
        node = self.node
        for i in range(self.width - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def set(self, place: int, rank: int) -> None:
        node, i = self.node, self.width + place
        node[i] = rank * self.width + place if rank < _NONE else _NONE
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a < b else b
            if node[i] == least:
                break
            node[i] = least
            i >>= 1


def merge_symbols(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges {pair: (rank, merged id)} to symbols until none applies."""
    n = len(ids)
    if n < 2:
        return ids
    nothing = (_NONE, 0)
    tree = RankTree([merges.get(p, nothing)[0] for p in zip(ids, ids[1:], strict=False)])
    node, width = tree.node, tree.width
    ids = [*ids]
    after = [*range(1, n + 1)]
    before = [*range(-1, n - 1)]
    while (root := node[1]) < _NONE:
        i = root % width
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            tree.set(j, _NONE)
        if k < n:
            before[k] = i
            tree.set(i, merges.get((ids[i], ids[k]), nothing)[0])
        else:
            tree.set(i, _NONE)
        if (h := before[i]) >= 0:
            tree.set(h, merges.get((ids[h], ids[i]), nothing)[0])
    return [x for x in ids if x >= 0]


class PairRanks:
    """Rank and merged id of symbol pairs, looked up for many pairs at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        pairs = np.fromiter((a << 32 | b for a, b in merges), np.int64, len(merges))
        ranks = np.fromiter((rank for rank, _ in merges.values()), np.int64, len(merges))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], (1 << 63) - 1)
        self.ranks = np.append(ranks[order], 0)
        self.merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        for rank, token in merges.values():
            self.merged[rank] = token

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE)


def merge_many(symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """The same merges for many short pre-tokens together, one segment tree a row.

    ``symbols``: a row for each pre-token, its width a power of two; places from ``lengths`` on are unused.
    Returns the symbols with -1 where one was merged into another.
    """
    rows, width = symbols.shape
    ids = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)
    places = np.arange(width)
    after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
    node = np.full((rows, 2 * width), _NONE, np.int64)
    first = ranks.of(symbols[:, :-1], symbols[:, 1:])
    first[places[1:] >= lengths[:, None]] = _NONE
    node[:, width:-1] = np.where(first < _NONE, first * width + places[:-1], _NONE)
    for i in range(width - 1, 0, -1):
        node[:, i] = np.minimum(node[:, 2 * i], node[:, 2 * i + 1])

    def update(row: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        i = place + width
        node[row, i] = np.where(rank < _NONE, rank * width + place, _NONE)
        for _ in range(width.bit_length() - 1):
            i >>= 1
            node[row, i] = np.minimum(node[row, 2 * i], node[row, 2 * i + 1])

    active = np.flatnonzero(node[:, 1] < _NONE)
    while len(active):
        root = node[active, 1]
        i, merged = root % width, ranks.merged[root // width]
        j = after[active, i]
        k = after[active, j]
        ids[active, i] = merged
        ids[active, j] = -1
        after[active, i] = k
        before[active, k] = i
        update(active, j, np.full(len(active), _NONE))
        follows = k < lengths[active]
        update(active, i, np.where(follows, ranks.of(merged, np.where(follows, ids[active, k], 0)), _NONE))
        h = before[active, i]
        led = h >= 0
        row, h = active[led], h[led]
        update(row, h, ranks.of(ids[row, h], merged[led]))
        active = active[node[active, 1] < _NONE]
    return ids[:, :width]


class Remembered:
    """Two generations of results: what is met again moves to the younger one, and a full one replaces the older."""

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self._young: dict[bytes, tuple] = {}
        self._old: dict[bytes, tuple] = {}

    def found(self, keys: Iterable[bytes]) -> tuple[dict[bytes, tuple], list[bytes]]:
        """What is known of the keys, and the keys that are not."""
        out, new = {}, []
        young, old = self._young, self._old
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    new.append(key)
                    continue
                young[key] = value
            out[key] = value
        return out, new

    def add(self, made: dict[bytes, tuple]) -> None:
        self._young.update((k, v) for k, v in made.items() if len(k) <= self.longest)
        if len(self._young) > self.most:
            self._old, self._young = self._young, {}


class BytePairs:
    """A byte-level BPE vocabulary with word ends, as stored in a ``tokenizers`` JSON file.

    The library reads the file, normalises and cuts texts into pre-tokens; the merges are made here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec.get("decoder") is not None:
            raise ValueError("a BPE file with word ends and without decoder is needed")
        kinds = [x["type"] for part, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec[part] or {}).get(of, [])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:  # what the short way in _pre_tokens relies on
            raise ValueError("a file that composes, lower-cases and splits into letters, digits and others is needed")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        self._ranks = PairRanks(self.merges)
        self._place = {s: b for b, s in enumerate(byte_symbols())}
        self._inner = np.array([vocab[s] for s in self._place])
        self._final = np.array([vocab[s + "</w>"] for s in self._place])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        # The library needs no vocabulary for these two; without it, reading takes neither its time nor its memory.
        model = {**model, "vocab": {}, "merges": []}
        library = Tokenizer.from_str(json.dumps({**spec, "model": model, "added_tokens": [], "post_processor": None}))
        self._normalise, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._runs, self._pieces = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def _pre_tokens(self, chunk: str) -> list[bytes | int]:
        """Pre-tokens as bytes, special tokens as ids, of a run without white space."""
        core = chunk.rstrip(".,")
        if core.isalpha() and (core.isascii() or max(core) < "\u0100"):  # the usual word: letters that compose with nothing, then full stops or commas
            word = core.lower().encode()
            return [word, chunk[len(core) :].encode()] if len(core) < len(chunk) else [word]
        out: list[bytes | int] = []
        at = 0
        for special in [*self._special.finditer(chunk), None]:
            plain = self._normalise(chunk[at : special.start() if special else len(chunk)])
            out += [bytes(map(self._place.__getitem__, piece)) for piece, _ in self._cut(plain)]
            if special:
                out.append(self.special[special[0]])
                at = special.end()
        return out

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of each pre-token: short ones many at a time, long ones one by one."""
        out = {}
        by_width = [(width, [w for w in words if low < len(w) <= width]) for low, width in ((0, 8), (8, 16), (16, 32))]
        for width, some in ((width, of[i : i + TREES]) for width, of in by_width for i in range(0, len(of), TREES)):
            lengths = np.array([*map(len, some)])
            data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in some]), np.uint8).reshape(-1, width)
            symbols = self._inner[data]
            rows = np.arange(len(some))
            symbols[rows, lengths - 1] = self._final[data[rows, lengths - 1]]
            merged = merge_many(symbols, lengths, self._ranks)
            merged[np.arange(width) >= lengths[:, None]] = -1
            kept = merged >= 0
            ends = np.cumsum(kept.sum(axis=1)).tolist()
            flat, begin = merged[kept].tolist(), 0
            for word, end in zip(some, ends, strict=True):
                out[word] = flat[begin:end]
                begin = end
        for word in words:
            if len(word) > 32:
                out[word] = merge_symbols([*self._inner[[*word[:-1]]].tolist(), int(self._final[word[-1]])], self.merges)
        return out

    def pieces(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, str, str]]:
        """(number of tokens, decimal ids, decoded text) of pre-tokens, each merged once while it is remembered."""
        out, new = self._pieces.found(words)
        made = {w: (len(ids), " ".join(map(str, ids)), self.decode(ids)) for w, ids in self.encode_words(new).items()}
        self._pieces.add(made)
        out.update(made)
        return out

    def chunks(self, runs: Iterable[bytes]) -> dict[bytes, tuple[int, str, str]]:
        """(number of tokens, decimal ids, decoded text) of each run between ASCII white space.

        No pre-token or special token holds white space, and composing never joins characters across it.
        Short runs and pre-tokens are remembered, up to a number.
        """
        out, new = self._runs.found(runs)
        cut = [self._pre_tokens(r.decode()) for r in new]
        of = self.pieces({w for words in cut for w in words if isinstance(w, bytes) and w})
        made = {}
        for run, words in zip(new, cut, strict=True):
            parts = [(1, str(w), self.token[w]) if isinstance(w, int) else of[w] for w in words if w != b""]
            made[run] = parts[0] if len(parts) == 1 else (sum(x[0] for x in parts), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts]))
        self._runs.add(made)
        out.update(made)
        return out

    def encode_texts(self, texts: Iterable[bytes], slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, decimal ids, decoded text) of each text, some megabytes at a time."""
        some, held = [], 0
        for text in texts:
            some.append(text.split())
            held += len(text)
            if held >= slice_bytes:
                yield from self._encode_runs(some)
                some, held = [], 0
        yield from self._encode_runs(some)

    def _encode_runs(self, some: list[list[bytes]]) -> Iterator[tuple[int, str, str]]:
        now = self.chunks(set().union(*some))
        for runs in some:
            kept = [x for x in map(now.__getitem__, runs) if x[0]]
            yield sum([x[0] for x in kept]), " ".join([x[1] for x in kept]), " ".join([x[2] for x in kept])

    def forget(self, remembered: int = REMEMBERED) -> None:
        """Give up what is remembered; the worker lives on after the task."""
        self._runs, self._pieces = Remembered(remembered), Remembered(remembered)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_texts([(text or "").encode()]) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by a space, special ones too: what a file without decoder gives."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    """One vocabulary a worker. A relative path names a file sent with ``SparkContext.addFile``."""
    pairs = BytePairs(path if path.startswith("/") else SparkFiles.get(path))
    release_memory()  # what reading the file took
    return pairs


def _digests(path: str, remembered: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        pairs.forget(remembered)
        for batch in batches:
            rows = []
            for n, ids, decoded in pairs.encode_texts(utf8(batch.column(1)), slice_bytes):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        pairs.forget()

    return run


def token_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    ``remembered`` and ``slice_bytes`` trade a worker's memory for time; the rows are the same.
    """
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(tidy(_digests(path, remembered, slice_bytes)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_column(text: Column, path: str) -> Column:
    """The token ids of each text, null as empty."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        pairs = load(path)
        return pa.array([pairs.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each list of token ids, null as empty."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        pairs = load(path)
        return pa.array([pairs.decode(x or ()) for x in lists.to_pylist()], pa.string())

    return decode(ids)
