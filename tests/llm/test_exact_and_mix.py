from __future__ import annotations

import hashlib
import string
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import repeat_filter
from holdfast.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from holdfast.llm.mixing import capped_shares, min_cost_flow, mix, mix_by_source, mixed_documents
from pyspark.sql import functions as F

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(doc_id)
    out = Counter()
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, keep, len(ids), i == keep, digest)] += 1
    return out


@pytest.mark.parametrize("which", ["edge", "real", "no"])
def test_exact_duplicates(request, which):
    docs = request.getfixturevalue(f"{which}_docs")
    rows = request.getfixturevalue(f"{which}_rows") if which != "no" else []
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(docs).collect())
    assert got == expected_groups(rows)


def test_one_row_of_each_text_stays(edge_docs, edge_rows):
    kept = drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = Counter((r["text"] or "").translate(LOWER) for r in kept.collect())
    assert texts == Counter({(t or "").translate(LOWER) for _, t, _ in edge_rows})


def test_filter_never_misses(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-(2**63), 2**63, 5_000), rng.integers(-(2**63), 2**63, 500)
    rows = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h bigint").repartition(7)
    seen = repeat_filter.build(rows, 6_000, least=2)
    assert seen.test(twice.view(np.uint64)).all()
    assert seen.test(once.view(np.uint64)).mean() < 0.1
    held = repeat_filter.build(rows, 6_000, least=1)
    assert held.test(once.view(np.uint64)).all()


def test_shares_stop_at_the_cap():
    shares = [float(x) for x in capped_shares([10, 1000, 90], [5, 2, 1])]
    assert shares[0] == 30 and sum(shares) == pytest.approx(1100)
    assert shares[1] / shares[2] == pytest.approx(2) or shares[2] == 270


def test_flow_prefers_first_uses():
    # One pattern belongs to both sources; the second source has no other words.
    flow = min_cost_flow([((0,), 100), ((0, 1), 50)], [90, 60])
    assert flow[(1, 1)] == 60 and flow[(0, 0)] == 90
    assert sum(words for (i, _), words in flow.items() if i == 1) == 60


@pytest.mark.parametrize("which", ["edge", "real"])
def test_mix_reaches_targets(request, which):
    docs = request.getfixturevalue(f"{which}_docs")
    rows = mix_by_source(docs).collect()
    assert len(rows) == docs.count()
    again = mix_by_source(docs.repartition(3)).collect()
    assert Counter(rows) == Counter(again)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["target"], r["source_size"]].append(r)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    total = sum(r["size"] for r in rows)
    _, targets = mix(docs, F.array("source"))
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    for (target, size), members in by_source.items():
        if which == "edge":
            largest = max(n * s for (_, s), n in Counter((r["doc_id"], r["size"]) for r in members).items())
        else:
            largest = max(r["size"] for r in members)
        alike = sum(t == (size, target) for t in targets.values())  # sources of one size and weight
        assert abs(sum(r["taken"] for r in members) - alike * target) <= alike * (largest / 2 + 1)


def test_mix_of_overlapping_sources(real_docs):
    sources = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b")))
    rows, targets = mix(real_docs, sources)
    assert set(targets) == {"a", "b"}
    rows = rows.collect()
    assert len(rows) == real_docs.count()
    assert all(r["times"] == 0 for r in rows if not r["sources"])


def test_mixed_documents_repeat_rows(edge_docs, no_docs):
    taken = Counter()
    for r in mix_by_source(edge_docs).collect():
        if r["size"]:
            taken[r["doc_id"]] += r["taken"] // r["size"]
    mixed = mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    got = Counter(r["doc_id"] for r in mixed.collect() if (r["text"] or "").split())
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert mixed_documents(no_docs).count() == 0 and mix_by_source(no_docs).count() == 0


@pytest.mark.parametrize("mixed", [mix_by_source, mixed_documents])
def test_the_mix_starts_no_python_workers(spark, mixed):
    docs = spark.range(40).selectExpr("id AS doc_id", "if(id % 7 = 0, null, concat('s', id % 3)) AS source", "repeat('a b ', cast(id % 5 AS int)) AS text")
    plan = mixed(docs)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan  # rows of a Python list; each executor would run workers for them


def test_exact_duplicates_load_no_pandas():
    loaded = "import sys, holdfast.llm.exact_dedup; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", loaded], check=False).returncode == 0


def test_positions_of_a_filter_take_four_bytes():
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 2_000_000).astype(np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(part.view(np.int64))], ["h"]) for part in np.split(hashes, 20)]
    tracemalloc.start()
    try:
        sent = [*repeat_filter._positions_of_partition(1 << 24, lambda batch: [repeat_filter._hashes_of(batch)])(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    positions = repeat_filter._positions(hashes, 1 << 24)
    positions[positions[:, 0] == positions[:, 1], 1] ^= np.uint64(1)
    at, times = np.unique(positions.ravel(), return_counts=True)
    for name, wanted in (("once", at[times == 1]), ("twice", at[times > 1])):
        got = [(chunk << 20) + np.frombuffer(low, np.uint32).astype(np.int64) for batch in sent for chunk, low in zip(batch["chunk"].to_pylist(), batch[name].to_pylist(), strict=True)]
        assert np.array_equal(np.concatenate(got), wanted.astype(np.int64))
