"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its word n-grams. Sets are grouped in bands of size such that sets that link are in the same or in
neighbouring bands. For each pair of neighbouring bands the largest symmetric difference ``k`` of linked sets is
known. The feature domain is divided into parts, each into pieces; there are so many parts that at least one of them holds
at most one difference. The subsets of a part's pieces that leave out one piece each give a signature, the hash of the
elements in them: sets that link share a signature. Parts beyond that number make up for subsets without elements, which
give no signature; a set with too many of these gives signatures for them too, so no link is lost (see ``signatures``).

Before that, sets that can't link with any other are put aside: a set that links has at most ``100 - percent`` of a hundred elements that
no other set holds. A repeat filter over a fixed share of the elements, chosen by their hash, tells which of these occur once only; a set
with too many of them is alone. The filter errs only towards "occurs again", so no link is lost.

Sets that share a signature are candidates. Buckets with few sets give their pairs. Larger buckets are searched with sketches:
a parity bitmap whose distance never exceeds the true one, so a pair beyond the bound needs no look at the sets. Of the
candidates that the sketches leave, each set is first verified with its nearest; then, where a bucket still holds
several components, all that lead from one component to another. Verification compares the whole sets. Components
come from the verified links.

Equal sets are one node from the start, so groups of copies cost one node. Shingles are compared by 64-bit hashes of their words and nodes by
a 64-bit hash of their set.

Cases: a null text, an empty one or one without words has an empty set and links with nothing; a text with fewer words
than ``n`` is its whole word sequence as one shingle; a text with a null id links like any other, but a null id
never becomes a component's id unless nothing in the component has one;
rows repeated as a whole are in one component; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import repeat_filter
from holdfast.llm.common import id_and_text, mix, ngram_hashes, some_texts, stored, text_words, tidy
from holdfast.llm.components import connected

# Buckets up to this size give all their pairs; members of larger ones are compared in blocks of so many.
SMALL_BUCKET = 16
BLOCK = 4_096
_U = np.uint64


class Bands:
    """Bands of set sizes for links from ``percent`` per cent similarity on."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        ends, low = [], 1
        while low <= most:
            high = low * 100 // percent
            ends.append(high)
            low = high + 1
        self.ends = np.array(ends, np.int64)
        # A part holds about this many elements; a signature should cover six of them or more.
        self.pieces = 2 if (100 + percent) // max(100 - percent, 1) >= 12 else 3

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.ends, n))

    def difference(self, band: int) -> int:
        """The largest symmetric difference of linked sets up to the end of a band."""
        return int((100 - self.percent) * 2 * self.ends[band] // (100 + self.percent))

    def sketch_bits(self, band: int) -> int:
        return max(64, 1 << (8 * self.difference(band)).bit_length())


def signatures(elements: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """The signatures of a set (distinct 64-bit hashes) towards the sets of ``band`` and the band before.

    Each part is divided into pieces; a signature is the hash of the elements in all pieces but one. With at most k
    differences over P parts, more than P - 1 - k // 2 parts hold at most one each, and without the piece that
    holds it both sets are the same there. So if at least one of these parts has elements whatever piece is left out,
    linked sets share a signature. That is certain while fewer than P - k // 2 parts have an empty one; otherwise
    empty ones count as well.
    """
    k = bands.difference(band)
    tag = mix(np.array([band + 1], _U))[0]
    if k == 0:  # only equal sets link
        return mix(np.array([elements.sum(dtype=_U)], _U) + tag)
    needed, pieces = k // 2 + 1, bands.pieces
    parts = needed + needed // 16 + 2
    u = mix(elements + _U(0xA24BAED4963EE407))
    cell = ((u >> _U(33)) % _U(parts)).astype(np.int64) * pieces + ((u & _U(0x7FFFFFFF)) % _U(pieces)).astype(np.int64)
    counts = np.bincount(cell, minlength=parts * pieces).reshape(parts, pieces)
    sums = np.zeros(parts * pieces, _U)
    np.add.at(sums, cell, mix(u))
    sums = sums.reshape(parts, pieces)
    left = (counts.sum(axis=1, keepdims=True) - counts).ravel()
    hashes = (sums.sum(axis=1, keepdims=True, dtype=_U) - sums).ravel()
    odd = int((left.reshape(parts, pieces) == 0).any(axis=1).sum())
    use = np.flatnonzero(left) if odd < parts - k // 2 else np.arange(parts * pieces)
    return mix(hashes[use] + mix(use.astype(_U) + tag))


def sketch(elements: np.ndarray, bits: int) -> bytes:
    """Parity of the elements in each of ``bits`` cells; two sketches differ in at most as many cells as the sets differ."""
    cell = (mix(elements + _U(0x94D049BB133111EB)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


class _Sets:
    """Word n-gram sets of texts, within one task."""

    def __init__(self, n: int):
        self.n = n

    def of_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text; the words of some texts are hashed together."""
        for _, some in some_texts(texts):
            words = text_words([t.lower() for t in some])  # changes A-Z only, cuts at the six white-space characters only
            grams = ngram_hashes(words.hashes, self.n)
            for a, b in itertools.pairwise(words.bounds.tolist()):
                if b - a >= self.n:
                    yield np.unique(grams[a : b - self.n + 1])
                elif b > a:
                    yield mix(ngram_hashes(words.hashes[a:b], b - a) + _U(b - a))
                else:
                    yield np.zeros(0, _U)

    def node(self, elements: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def _node_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(n)
        for batch in batches:
            sizes, nodes = [], []
            for elements in sets.of_column(batch.column(1)):
                sizes.append(len(elements))
                nodes.append(sets.node(elements) if len(elements) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "row_key", "n", "node"]
            )

    return run


def sampled(elements: np.ndarray, percent: int) -> np.ndarray:
    """A share of the elements by their hash, somewhat more than twice what a set that links may have for itself."""
    share = min(256, 256 * 22 * (100 - percent) // 1_000 + 1)
    return elements[(mix(elements + _U(0xC2B2AE3D27D4EB4F)) & _U(255)) < _U(share)]


def _sampled_sets(n: int, percent: int):
    """Reads the sampled elements of the sets of a batch of texts, some texts at a time."""

    sets = _Sets(n)

    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        some, held = [], 0
        for elements in sets.of_column(batch.column(1)):
            found = sampled(elements, percent)
            some.append(found)
            held += len(found)
            if held > 500_000:
                yield np.concatenate(some)
                some, held = [], 0
        if some:
            yield np.concatenate(some)

    return read


def may_link(elements: np.ndarray, percent: int, seen: repeat_filter.HashFilter) -> bool:
    """False for a set with more elements of its own than a set that links can have."""
    some = sampled(elements, percent)
    alone = len(some) - int(seen.test(some).sum())
    return 100 * alone <= (100 - percent) * len(elements)


def _signature_batches(n: int, bands: Bands, seen: repeat_filter.HashFilter):
    """(sig, node, n, band): for the set's own band and the next; a set met again in the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, met = _Sets(n), set()
        for batch in batches:
            sigs, nodes, sizes, towards = [], [], [], []
            held = 0

            def flush():
                lengths = [len(s) for s in sigs]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sigs).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.repeat(np.array(towards, np.int16), lengths)),
                    ],
                    ["sig", "node", "n", "band"],
                )

            for elements in sets.of_column(batch.column(1)):
                if not len(elements) or not may_link(elements, bands.percent, seen):
                    continue
                node = sets.node(elements)
                if node in met:
                    continue
                if len(met) > 300_000:
                    met.clear()
                met.add(node)
                own = bands.of(len(elements))
                for band in (own, own + 1):
                    found = signatures(elements, band, bands)
                    sigs.append(found)
                    nodes.append(node)
                    sizes.append(len(elements))
                    towards.append(band)
                    held += len(found)
                if held > 200_000:
                    yield flush()
                    sigs, nodes, sizes, towards, held = [], [], [], [], 0
            if sigs:
                yield flush()

    return run


def _bucket_batches(bands: Bands):
    """Rows sorted by (sig, node) to pairs of small buckets (bucket null) and members of large ones (b null).

    ``band`` names the sketches with which they can be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def handle(sig, node, n, band):
            change = np.flatnonzero(np.diff(sig)) + 1
            begins = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(sig)]])
            big = ends - begins > 1
            a, b, bands_of, bucket = [], [], [], []
            for lo, hi in zip(begins[big].tolist(), ends[big].tolist(), strict=True):
                keep = np.concatenate([[True], np.diff(node[lo:hi]) != 0])  # one set met by several tasks
                nodes, sizes = node[lo:hi][keep], n[lo:hi][keep]
                t, at = len(nodes), int(band[lo])
                if t < 2:
                    continue
                if t <= SMALL_BUCKET:
                    i, j = np.triu_indices(t, 1)
                    x, y = sizes[i], sizes[j]
                    # Sets of one band meet in their own bucket, so the next band's bucket needn't repeat them.
                    first = bands.ends[at - 1] if at else 0
                    good = (100 * np.minimum(x, y) >= bands.percent * np.maximum(x, y)) & (np.maximum(x, y) > first)
                    a.append(nodes[i][good])
                    b.append(nodes[j][good])
                    bands_of.append(np.full(int(good.sum()), at))
                elif sizes.max() > (bands.ends[at - 1] if at else 0):
                    blocks = -(-t // BLOCK)
                    which = np.arange(t) % blocks
                    for i in range(blocks):
                        for j in range(i, blocks):
                            members = nodes[(which == i) | (which == j)]
                            bucket.append((xxhash.xxh3_64_intdigest(f"{sig[lo]} {i} {j}") - (1 << 63), at, members))
            pairs = np.unique(np.stack([np.concatenate(x) for x in (a, b, bands_of)], axis=1), axis=0) if a else np.zeros((0, 3), np.int64)
            rows = [(pairs[:, 0], pairs[:, 1], None, pairs[:, 2])] + [(m, None, k, np.full(len(m), at)) for k, at, m in bucket]
            for first, second, key, at in rows:
                if len(first):
                    size = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(first, pa.int64()),
                            pa.array(second, pa.int64()) if second is not None else pa.nulls(size, pa.int64()),
                            pa.array([key] * size, pa.int64()),
                            pa.array(at.astype(np.int16)),
                        ],
                        ["a", "b", "bucket", "band"],
                    )

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if left is not None:
                now = [np.concatenate([x, y]) for x, y in zip(left, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0] != now[0][-1], False)) if now[0][0] != now[0][-1] else 0
            last = len(now[0]) - int((now[0] == now[0][-1]).sum())
            left = [x[last:] for x in now]
            if last:
                yield from handle(*(x[:last] for x in now))
        if left is not None and len(left[0]):
            yield from handle(*left)

    return run


def _member_batches(n: int, bands: Bands, wanted: repeat_filter.HashFilter):
    """Sets and sketches of the rows whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(n)
        names = ["node", "n", "own", "elements", "sketch", "next_sketch"]
        kinds = [pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            some = batch.filter(pa.array(wanted.test(mix(keys.view(_U)))))
            rows = []
            for elements in sets.of_column(some.column(1)):
                if len(elements):
                    own = bands.of(len(elements))
                    sketches = [sketch(elements, bands.sketch_bits(x)) for x in (own, own + 1)]
                    rows.append((sets.node(elements), len(elements), own, elements.tobytes(), *sketches))
            columns = [*zip(*rows, strict=True)] if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


@F.arrow_udf(T.IntegerType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cells in which two sketches differ."""
    out = [
        int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)
    ]
    return pa.array(out, pa.int32())


@F.arrow_udf(T.IntegerType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Elements that two sets have in common."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        out.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
    return pa.array(out, pa.int32())


def _near_in_buckets(percent: int, nearest_only: bool):
    """Rows (bucket, node, n, sketch, label) sorted by bucket to pairs (a, b, distance) across labels within the bound."""

    def search(nodes, sizes, sketches, labels):
        data = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(nodes), -1)
        step = max(1, (1 << 22) // (len(nodes) * data.shape[1]))
        for lo in range(0, len(nodes), step):
            hi = min(len(nodes), lo + step)
            far = np.bitwise_count(data[lo:hi, None, :] ^ data[None, :, :]).sum(axis=2, dtype=np.int64)
            total = sizes[lo:hi, None] + sizes[None, :]
            good = (far * (100 + percent) <= (100 - percent) * total) & (labels[lo:hi, None] != labels[None, :])
            if nearest_only:
                far = np.where(good, far, np.iinfo(np.int64).max)
                j = far.argmin(axis=1)
                i = np.flatnonzero(far[np.arange(hi - lo), j] < np.iinfo(np.int64).max)
                j = j[i]
            else:
                good &= np.arange(len(nodes))[None, :] > np.arange(lo, hi)[:, None]
                i, j = np.nonzero(good)
            if len(i):
                x, y = nodes[lo + i], nodes[j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far[i, j].astype(np.int32))], ["a", "b", "distance"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish():
            if len(held) > 1:
                nodes, sizes, sketches, labels = zip(*held, strict=True)
                nodes, first = np.unique(np.array(nodes, np.int64), return_index=True)
                if len(nodes) > 1:
                    sizes, labels = np.array(sizes, np.int64)[first], np.array(labels, np.int64)[first]
                    yield from search(nodes, sizes, [sketches[i] for i in first], labels)

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    yield from finish()
                    at, held = bucket, []
                held.append(row)
        yield from finish()

    return run


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    a = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("of_a"))
    b = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("of_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("common", _common("of_a", "of_b"))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _with_labels(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    mine = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return rows.join(mine, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links from ``percent`` per cent Jaccard similarity on."""
    return _classes(docs, n, percent, id_col, text_col).drop("row_key")


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key (a hash of id and text), n_shingles, component_id."""
    bands, texts = Bands(percent), id_and_text(docs, id_col, text_col)
    keyed = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    nodes = stored(keyed.mapInArrow(tidy(_node_batches(n)), "doc_id bigint, row_key bigint, n bigint, node bigint"), "join-nodes")
    elements = nodes.agg(F.sum("n")).first()[0] or 0
    repeated = repeat_filter.build(texts, elements * 22 * (100 - percent) // 1_000, least=2, read=_sampled_sets(n, percent), bits_per_row=4)
    sigs = texts.mapInArrow(tidy(_signature_batches(n, bands, repeated)), "sig bigint, node bigint, n int, band short")
    buckets = sigs.repartition("sig").sortWithinPartitions("sig", "node")
    found = stored(buckets.mapInArrow(tidy(_bucket_batches(bands)), "a bigint, b bigint, bucket bigint, band short"), "join-buckets")
    repeated.release()
    pairs = stored(found.filter("bucket is null").select("a", "b", "band").distinct(), "join-pairs")
    crowded = found.filter("bucket is not null").select("bucket", "band", F.col("a").alias("node"))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    rows = nodes.groupBy("node").agg(F.min("row_key").alias("row_key")).join(wanted, "node", "left_semi").select("row_key")
    rows = stored(rows, "join-rows")  # one row of each wanted set, with an id or without
    seen = repeat_filter.build(rows, rows.count(), least=1, read=_mixed_keys)
    schema = "node bigint, n bigint, own short, elements binary, sketch binary, next_sketch binary"
    members = stored(keyed.mapInArrow(tidy(_member_batches(n, bands, seen)), schema), "join-members")
    seen.release()

    near = stored(_near_pairs(pairs, members, percent), "join-near")
    crowded = stored(_crowded_rows(crowded, members), "join-crowded")
    # First each set with its nearest, then whatever still leads from one component to another.
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    nearest = both.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    nearest = nearest.unionByName(_crowded_pairs(crowded, None, percent, nearest_only=True).select("a", "b"))
    nearest = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(_verified(nearest, members, percent), "join-links")
    labels = connected(links)
    rest = near.select("a", "b").unionByName(_crowded_pairs(crowded, labels, percent, nearest_only=False).select("a", "b"))
    rest = _with_labels(_with_labels(rest, labels, "a", "of_a"), labels, "b", "of_b").filter("of_a <> of_b").select("a", "b").distinct()
    links = links.unionByName(stored(_verified(rest, members, percent), "join-links"))
    return _components(nodes, connected(links))


def _mixed_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U))


def _sketches(members: DataFrame) -> DataFrame:
    """(node, n, band, sketch): two rows a set, for its own band and the next."""
    own = members.select("node", "n", F.col("own").alias("band"), "sketch")
    return own.unionByName(members.select("node", "n", (F.col("own") + 1).cast("short").alias("band"), F.col("next_sketch").alias("sketch")))


def _near_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance) of the pairs whose sketches allow a link."""
    sketches = _sketches(members)
    a = sketches.select(F.col("node").alias("a"), "band", F.col("n").alias("n_a"), F.col("sketch").alias("of_a"))
    b = sketches.select(F.col("node").alias("b"), "band", F.col("n").alias("n_b"), F.col("sketch").alias("of_b"))
    far = pairs.join(a, ["a", "band"]).join(b, ["b", "band"]).withColumn("distance", _distance("of_a", "of_b"))
    return far.filter((100 + percent) * F.col("distance") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "distance")


def _crowded_rows(crowded: DataFrame, members: DataFrame) -> DataFrame:
    """(bucket, node, n, sketch) with the sketch that all members of the bucket have."""
    one = _sketches(members).dropDuplicates(["node", "band"])
    return crowded.join(one, ["node", "band"]).select("bucket", "node", "n", "sketch")


def _crowded_pairs(crowded: DataFrame, labels: DataFrame | None, percent: int, nearest_only: bool) -> DataFrame:
    rows = crowded.withColumn("label", F.col("node")) if labels is None else _with_labels(crowded, labels, "node", "label")
    rows = rows.select("bucket", "node", "n", "sketch", "label").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidy(_near_in_buckets(percent, nearest_only)), "a bigint, b bigint, distance int")


def _components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest id of each component, by document."""
    classes = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = _with_labels(classes, labels, "node", "label")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = stored(labelled.join(least, "label").select("node", "component_id"), "join-classes")
    rows = nodes.join(by_node, "node", "left")
    return rows.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns. Rows without id stay.

    A filter of the rows to drop lets nearly all others pass straight; only rows that may be among them are joined
    by id and text, since rows with one id can have different texts.
    """
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    classes = _classes(docs, n, percent, id_col, text_col)
    gone = stored(classes.filter("doc_id <> component_id").select(F.col("row_key").alias("_join_key")).distinct(), "join-gone")
    seen = repeat_filter.build(gone, gone.count(), least=1, read=_mixed_keys)

    @F.arrow_udf(T.BooleanType())
    def may_go(keys: pa.Array) -> pa.Array:
        return pa.array(seen.test(mix(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(_U))))

    marked = docs.withColumn("_join_key", key).withColumn("_join_may_go", may_go("_join_key"))
    straight = marked.filter(~F.col("_join_may_go")).select(*docs.columns)
    doubtful = marked.filter("_join_may_go").join(gone, "_join_key", "left_anti").select(*docs.columns)
    return straight.unionByName(doubtful)
