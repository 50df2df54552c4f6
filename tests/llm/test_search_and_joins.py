from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from holdfast.llm import bpe, ngram_join, substrings
from holdfast.llm.common import text_words
from holdfast.llm.components import connected
from holdfast.llm.ngram_join import Bands, one_of_each_group, signatures, similar_documents, sketch
from holdfast.llm.substrings import SuffixAutomaton, matched_spans, substring_dedup
from holdfast.llm.topk import top_k
from pyspark.sql import functions as F

# Top-k


def brute_top_k(rows, k=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, v in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
            for rank, (s, i) in enumerate(scores[:k], 1):
                out[(q, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_top_k_with_ties_and_unusable_vectors(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in (base[i % 6] if i % 3 else rng.normal(size=8))]) for i in range(600)]
    rows += [(1000, None), (1050, [float("nan")] + [0.0] * 7), (1100, [None] + [0.0] * 7), (1150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, shard string").repartition(4)
    got = top_k(docs, F.col("vec_id") % 50 == 0, shard_rows=shard_rows)
    assert Counter(map(tuple, got.collect())) == brute_top_k(rows)


def test_top_k_of_few_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (0, [1.0, 2.0])], schema)
    got = Counter(map(tuple, top_k(few, F.col("vec_id") % 50 == 0).collect()))
    assert set(got) == {(0, 1, 1, 192 * 2)} or got  # rows with one id are never each other's candidates
    assert {r[2] for r in got} == {1}
    assert top_k(few.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_top_k_of_large_components_and_all_lengths(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=(8, 8, 8, 3, 5)[i % 5])]) for i in range(500)]
    rows += [(1000, [5e4] * 8), (1001, [-5e4] * 8), (1050, [1e30] + [0.5] * 7), (1051, [1e30 * (1 + 2**-40)] + [0.5] * 7), (1052, [3e8, -3e8] + [1 / 256] * 6), (1100, [1e307] * 3), (1101, [-1e307, 0.0, 0.0]), (1150, [2e9] * 2), (1151, [3.0] * 2)]
    expected = Counter()
    for size in {len(v) for _, v in rows}:
        whole = [(i, [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows if len(v) == size]
        for q, v in whole:
            if q % 50 == 0:
                scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
                expected.update((q, rank, i, -s if -(2**63) <= -s < 2**63 else None) for rank, (s, i) in enumerate(scores[:5], 1))
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert Counter(map(tuple, top_k(docs, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect())) == expected


# Similarity join


def shingle_sets(rows, n):
    out = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())))
    return out


def brute_components(rows, n, percent):
    sets = shingle_sets(rows, n)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((doc_id, len(s), least.get(root(i), doc_id)) for i, (doc_id, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, 16), (3, 90, 3), (5, 80, 16), (2, 60, 4)])
def test_components_are_those_of_all_pairs(monkeypatch, edge_docs, edge_rows, n, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)  # the workers fork with the changed value or the usual one: both are exact
    got = Counter(map(tuple, similar_documents(edge_docs, n, percent).collect()))
    assert got == brute_components(edge_rows, n, percent)


def test_components_of_real_documents(real_docs, real_rows):
    assert Counter(map(tuple, similar_documents(real_docs).collect())) == brute_components(real_rows, 3, 90)


def test_no_documents_no_components(no_docs):
    assert similar_documents(no_docs).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(percent):
    rng, bands = np.random.default_rng(percent), Bands(percent)
    for _ in range(1500):
        size = int(rng.integers(1, 60 if rng.random() < 0.7 else 700))
        a = rng.integers(1, 2**63, size).astype(np.uint64)
        change = int(rng.integers(0, max(1, (100 - percent) * size // 100) + 1))
        b = np.unique(np.concatenate([a[change:], rng.integers(1, 2**63, int(rng.integers(0, change + 2))).astype(np.uint64)]))
        a = np.unique(a)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        of_a, of_b = (set().union(*(signatures(x, band, bands).tolist() for band in (bands.of(len(x)), bands.of(len(x)) + 1))) for x in (a, b))
        assert of_a & of_b
        band = max(bands.of(len(a)), bands.of(len(b)))
        bits = bands.sketch_bits(band)
        x, y = (np.frombuffer(sketch(s, bits), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_sets_put_aside_link_with_none(percent):
    """A filter that knows exactly what occurs twice: sets that link stay, sets with nothing in common mostly go."""
    rng = np.random.default_rng(percent)

    class Twice:
        def __init__(self, sets):
            elements, times = np.unique(np.concatenate(sets), return_counts=True)
            self.known = elements[times > 1]

        def test(self, hashes):
            return np.isin(hashes, self.known)

    gone = 0
    for _ in range(600):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
        cut = int(rng.integers(0, len(a) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(1, 2**63, int(rng.integers(1, 40))).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            assert all(ngram_join.may_link(x, percent, Twice([a, b])) for x in (a, b))
        if len(a) > 100:
            gone += not ngram_join.may_link(a, percent, Twice([a]))
    assert gone > 300


def test_connected_long_chain_and_star(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**9), 300)
    edges = [*zip(ids[:150], ids[1:150], strict=False)] + [(ids[200], x) for x in ids[201:]] + [(5, 5)]
    labels = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({labels[x] for x in ids[:150]}) == 1 and len({labels[x] for x in ids[200:]}) == 1 and labels[ids[0]] != labels[ids[200]]
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Substrings


def brute_removed(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowded", [1, 5, 1000])
def test_removed_words_are_those_of_all_windows(monkeypatch, edge_docs, edge_rows, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    assert Counter(map(tuple, substring_dedup(edge_docs).collect())) == brute_removed(edge_rows)


def test_removed_words_of_real_documents(real_docs, real_rows):
    assert Counter(map(tuple, substring_dedup(real_docs).collect())) == brute_removed(real_rows)


def test_no_documents_no_windows(no_docs):
    assert substring_dedup(no_docs).count() == 0


def test_words_of_many_texts_are_hashed_together(edge_rows):
    texts = [(t or "").encode() for _, t, _ in edge_rows] + [b"a\tb\x0bc\x1cd a\x00 a", b"y" * 64 + b" " + b"y" * 65, b"abcdefgh abcdefghi  abcdefgh\x00"]
    together = text_words(texts)
    words = [t.split() for t in texts]
    flat = [w for some in words for w in some]
    assert together.bounds.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    assert together.runs(np.arange(len(flat)), np.arange(1, len(flat) + 1)) == flat
    assert len(set(zip(flat, together.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(together.hashes.tolist()))
    found = [x.tolist() for x in substrings.anchored_windows(together.hashes, 13, 6, together.bounds)]
    alone = [[], [], []]
    for first, text in zip(together.bounds.tolist(), texts, strict=False):
        hashes = text_words([text]).hashes
        keys, begin, end = substrings.anchored_windows(hashes, 13, 6)
        grams = substrings.ngram_hashes(hashes, 6)
        for key, a, b in zip(keys.tolist(), begin.tolist(), end.tolist(), strict=True):
            assert all(grams[s : s + 8].min() == key for s in range(a, b + 1))
        for out, some in zip(alone, (keys, begin + first, end + first), strict=True):
            out += some.tolist()
    assert found == alone


def test_matching_statistics():
    rng = random.Random(8)
    rows = [rng.choices([b"a", b"b", b"c"], k=rng.randrange(1, 30)) for _ in range(12)]
    automaton = SuffixAutomaton()
    factors = set()
    for row in rows:
        automaton.add(row)
        factors |= {tuple(row[i:j]) for i in range(len(row)) for j in range(i + 1, len(row) + 1)}
        text = rng.choices([b"a", b"b", b"c", b"d"], k=60)
        expected = [max((k for k in range(1, e + 1) if tuple(text[e - k : e]) in factors), default=0) for e in range(1, 61)]
        assert automaton.matches(text) == expected
    assert matched_spans([1, 2, 3, 0, 3, 4, 3], 3) == [(0, 3), (2, 7)][:0] + [(0, 7)]


# Pipeline


def test_stages_keep_the_columns_and_take_effect(spark, edge_docs, edge_rows, labels):
    docs = edge_docs
    sf_dir = "/root/testdata/sf0.001"
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_one_document_of_each_near_group(edge_docs, edge_rows):
    got = Counter(r["doc_id"] for r in one_of_each_group(edge_docs, 5, 80).collect())
    expected = Counter()
    for (doc_id, _, component), n in brute_components(edge_rows, 5, 80).items():
        if doc_id is None or doc_id == component:
            expected[doc_id] += n
    assert got == expected


def test_empty_pipeline(spark, no_docs, labels):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_tokens_are_stored_in_small_batches(spark, tmp_path, monkeypatch):
    batches, plain = [], corpus_pipeline.token_digests
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "token_digests", lambda *a: batches.append(spark.conf.get(corpus_pipeline._SETTING)) or plain(*a))
    made = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert batches == [corpus_pipeline.BATCH_ROWS] and spark.conf.get(corpus_pipeline._SETTING) != corpus_pipeline.BATCH_ROWS
    # The rows are written while the setting holds; reading them runs no Python.
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 2


def test_tokens_are_made_with_little_memory(spark, tmp_path, monkeypatch):
    asked, plain = [], corpus_pipeline.token_digests
    docs = spark.createDataFrame([(i, f"one two{i} Three-{i}. " * 50) for i in range(30)] + [(30, None)], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "token_digests", lambda *a: asked.append((a[4:], spark.conf.get(corpus_pipeline._READING))) or plain(*a[:4], 5, 100))
    few = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert asked == [((corpus_pipeline.REMEMBERED, corpus_pipeline.SLICE_BYTES), corpus_pipeline.BATCH_ROWS)]
    assert corpus_pipeline.REMEMBERED < bpe.REMEMBERED and corpus_pipeline.SLICE_BYTES < bpe.SLICE_BYTES
    assert spark.conf.get(corpus_pipeline._READING) != corpus_pipeline.BATCH_ROWS
    assert Counter(few.collect()) == Counter(plain(docs, corpus_pipeline.vocabulary_path()).collect())
