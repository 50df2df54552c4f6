from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from domain import rows
from pyspark.sql import functions as F

from holdfast.functions import text as X
from holdfast.operators import enrichment, search, segments, vector_index, vectors
from holdfast.operators.segments import SegmentedIndex, ShardLists
from holdfast.operators.vector_index import add_vectors, approximate_search, build_vector_index, probe_report, recall_against
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import subfolders


def test_enrich_english_call(spark):
    calls = rows(
        spark,
        "interactions",
        {"interaction_id": "I1", "content": "Hello there. My claim is delayed and I am unhappy! Acko and HDFC Ergo are better. I am Cancelling now."},
        {"interaction_id": "I2", "content": "Thanks, that was quick and helpful."},
        {"interaction_id": "I3", "content": "   "},
    )
    found = {r.interaction_id: r for r in enrichment.enrich(calls, X.INSURANCE_RULES).collect()}
    assert set(found) == {"I1", "I2"}
    angry, happy = found["I1"], found["I2"]
    assert (angry.sentiment_label, angry.primary_intent, angry.churn_signal, angry.competitor) == (
        "negative",
        "complaint",
        "cancellation_intent",
        "Acko",
    )
    assert angry.key_quote == "My claim is delayed and I am unhappy!"
    assert (happy.sentiment_score, happy.churn_signal, happy.competitor) == (1.0, "none", None)


def test_override_replaces_another_signal(spark):
    made = spark.createDataFrame([("We may go with Digit. Cancelling!",), ("We may go with Digit.",)], "content string")
    signal = X.override_signal(F.lit("competitor_mention"), F.lower("content"), ("cancel",), "cancellation_intent")
    assert [r[0] for r in made.select(signal).collect()] == ["cancellation_intent", "competitor_mention"]


def test_longer_name_wins_at_the_same_place(spark):
    made = spark.createDataFrame([("i like tata aig best",)], "t string")
    assert made.select(X.first_mention(F.col("t"), ("Tata", "Tata AIG"))).first()[0] == "Tata AIG"


def test_names_are_whole_words(spark):
    made = spark.createDataFrame([("a digital payment",), ("rackoon",), ("go digit!",), ("डिजिट digit",), ("acko",)], "t string")
    found = [r[0] for r in made.select(X.first_mention(F.col("t"), ("Digit", "Acko"))).collect()]
    assert found == [None, None, "Digit", "Digit", "Acko"]


def test_sentences_do_not_end_inside_numbers(spark):
    made = spark.createDataFrame([("I made a digital payment of Rs. 13.5 lakh today. All good... Why?! मैं खुश हूँ। ठीक है\nnew line",)], "t string")
    assert made.select(X.sentences("t")).first()[0] == [
        "I made a digital payment of Rs. 13.5 lakh today.", "All good...", "Why?!", "मैं खुश हूँ।", "ठीक है", "new line",
    ]
    assert made.select(X.tokens(F.lit("खुश हूँ café-déjà"))).first()[0] == ["खुश", "हूँ", "café", "déjà"]


def test_model_output(spark):
    raw = [
        (1, '```json\n{"intent":"renewal","churn_signal":"price_shock","competitor":"null","key_quote":"Too much"}\n```'),
        (2, '{"intent":"renewal","churn_signal"'),
        (3, '{"intent":"shopping","churn_signal":"none","competitor":null,"key_quote":null}'),
        (4, None),
    ]
    df = spark.createDataFrame(raw, "id int, raw string")
    found = {r.id: r for r in enrichment.parse_model_output(df, "raw").collect()}
    assert (found[1].primary_intent, found[1].churn_signal, found[1].competitor, found[1].key_quote) == ("renewal", "price_shock", None, "Too much")
    assert (found[2].parsed, found[2].primary_intent, found[2].churn_signal) == (False, "general", "none")
    assert (found[3].primary_intent, found[3].unknown_value, found[3].key_quote) == ("general", True, None)
    assert (found[4].parsed, found[4].primary_intent) == (False, "general")


def _corpus(n):
    words = ["delay", "claim", "price", "call", "agent", "été", "policy", "x1"]
    return [(i, " ".join(words[(i * j + j) % len(words)] for j in range(1, 4 + i % 9)) + ("!" if i % 2 else ".")) for i in range(n)]


def _bm25(corpus, query):
    docs = {i: [w for w in re.split(r"[\W_]+", t.lower()) if w] for i, t in corpus}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set(re.split(r"[\W_]+", query.lower())) - {""}:
        df = sum(term in d for d in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, d in docs.items():
            tf = Counter(d)[term]
            if tf:
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda p: (-p[1], p[0]))


QUESTIONS = [(1, "Delay of the CLAIM"), (2, "été price"), (3, "nothing known here"), (4, "agent, agent: policy x1")]


def _hits(found, q):
    return [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]


def test_batch_search_over_growing_segments_equals_brute_force(spark, tmp_path):
    corpus = _corpus(120)
    docs = spark.createDataFrame(corpus, "id bigint, body string").withColumn("kind", F.col("id") % 3)
    index = SegmentedIndex(Tables(spark, str(tmp_path)), "id", "body", ["kind"], shard_docs=11, fan=3)
    asked = spark.createDataFrame(QUESTIONS + QUESTIONS[:1], "q bigint, t string")  # a question asked twice counts once
    assert index.search_batch(asked, "q", "t").count() == 0
    ids = sorted(i for i, _ in corpus)
    for upto in (10, 40, 41, 90, len(ids)):
        part = docs.filter(F.col("id") <= ids[upto - 1])  # with all that is there already, which adds nothing
        index.add(part.unionByName(part.limit(3)))
        now = [(i, t) for i, t in corpus if i <= ids[upto - 1]]
        found = index.search_batch(asked, "q", "t", k=7).collect()
        for q, t in QUESTIONS:
            assert _hits(found, q) == _bm25(now, t)[:7]
    assert len(index.segments()) < 5 and index.corpus().n_docs == len(ids)
    odd = index.search_batch(asked, "q", "t", k=4, where=F.col("kind") == 1).collect()
    for q, t in QUESTIONS:
        assert _hits(odd, q) == [p for p in _bm25(corpus, t) if p[0] % 3 == 1][:4]
    expected = {(r.doc_id, r.term, r.tf, r.length) for r in search.postings(docs, "id", "body").collect()}
    assert {tuple(r) for r in index.postings().select("doc_id", "term", "tf", "length").collect()} == expected
    live = len(index.segments())
    index.vacuum()
    assert sum(x.startswith("s-") for x in subfolders(spark, index.live.root)) == live
    assert _hits(index.search_batch(asked, "q", "t", k=7).collect(), 1) == _bm25(corpus, QUESTIONS[0][1])[:7]


def test_bounds_spare_postings_and_lose_no_document():
    rng = np.random.default_rng(5)
    lengths = rng.integers(20, 400, 3_000)
    shard = ShardLists(lengths, float(lengths.mean()), None)
    exact, terms = np.zeros(3_000), []
    for k, n in enumerate([3, 5, 40, 200, 1_500, 2_500, 2_900]):
        places = np.sort(rng.choice(3_000, n, replace=False)).astype(np.int32)
        counts = rng.integers(1, 6, n).astype(np.int32)
        idf = float(np.log(1 + (3_000 - n + 0.5) / (n + 0.5)))
        shard.add(f"t{k}", places, counts, int(counts.max()), int(lengths[places].min()))
        exact[places] += shard._weights(idf, places, counts)
        terms.append((idf, f"t{k}"))
    places, scores = shard.best(terms, 5)
    best = np.lexsort((places, -scores))[:5]
    truth = np.lexsort((np.arange(3_000), -np.round(exact, 6)))[:5]
    assert places[best].tolist() == truth.tolist() and np.allclose(scores[best], np.round(exact[truth], 6))
    assert shard.looked_at < 0.2 * sum([3, 5, 40, 200, 1_500, 2_500, 2_900])


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.3 * rng.normal(size=16)).tolist(), i % 2) for i in range(900)]
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [1.0] * 3, 0), (2004, [], 1)]
    vecs = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, kind int").repartition(4)
    asked = vecs.filter("vec_id % 30 = 0").withColumnRenamed("vec_id", "q")
    whole = vecs.filter(F.size("embedding") == 16)
    exact = sorted(map(tuple, vectors.vector_search(whole, asked, "q").collect()))
    index = build_vector_index(vecs.filter("vec_id < 600 or vec_id >= 2000"), str(tmp_path / "index"), attributes=["kind"], recall=0.9)
    index = add_vectors(index, vecs.filter("vec_id >= 600 and vec_id < 2000"), str(tmp_path / "index"))
    assert sorted(map(tuple, approximate_search(index, asked, "q", probes=10**6, part_rows=37).collect())) == exact
    found = approximate_search(index, asked, "q")
    recall = recall_against(found, vectors.vector_search(whole, asked, "q")).first()
    report = probe_report(index, asked, "q").first()
    assert recall["recall"] >= 0.9 and report["rows_indexed"] == 900 and report["rows_compared"] < 450 and report["queries"] == 30
    some = approximate_search(index, asked, "q", where=F.col("kind") == 1, probes=10**6).collect()
    assert {r.vec_id % 2 for r in some} == {1} and len(some) == 150
    nothing = build_vector_index(vecs.limit(0), str(tmp_path / "none"))
    assert approximate_search(nothing, asked.limit(0), "q").count() == 0


def test_index_search_equals_brute_force(spark, tmp_path):
    corpus = _corpus(60)
    docs = spark.createDataFrame(corpus, "id bigint, body string").withColumn("kind", F.col("id") % 2)
    index = search.write_index(search.build_index(docs, "id", "body", ["kind"]), str(tmp_path / "index"))
    for _, t in QUESTIONS:
        assert [(r.doc_id, r.score) for r in search.search(index, t, k=6).collect()] == _bm25(corpus, t)[:6]
        odd = [(r.doc_id, r.score) for r in search.search(index, t, k=6, where=F.col("kind") == 1).collect()]
        assert odd == [p for p in _bm25(corpus, t) if p[0] % 2 == 1][:6]


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(10_000, 100), (7, 1)])
def test_vector_search_equals_brute_force(spark, shard_rows, block_rows):
    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    made = [(i, [math.sin(i), math.cos(3 * i), float(i % 5) - 2]) for i in range(80)] + [(80, [0.0, 0.0, 0.0])]
    vecs = spark.createDataFrame([*made, (81, None), (82, [1.0, None, 2.0])], "vec_id bigint, embedding array<double>").repartition(4)
    asked = [("a", [1.0, 0.0, 0.5]), ("b", [0.0, -1.0, 1.0])]
    queries = spark.createDataFrame(asked, "name string, embedding array<double>")
    found = vectors.vector_search(vecs, queries, "name", k=9, shard_rows=shard_rows, block_rows=block_rows).collect()
    for name, q in asked:
        truth = sorted(((i, cosine(v, q)) for i, v in made if any(v)), key=lambda p: (-p[1], p[0]))[:9]
        mine = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == name]
        assert mine == truth


def test_first_mention_searches_a_text_once_for_all_names(spark):
    names = ("Acko", "Tata AIG", "Tata", "SBI General", "digit")
    column = X.first_mention(F.col("t"), names)
    plan = spark.createDataFrame([("",)], "t string").select(column.alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1 and "split(" not in plan
    texts = ["tata aig, not acko", "xacko acko2 digit.", "tata-aig tata aig", "sbi general", "ackodigit", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == ["Tata AIG", "digit", "Tata", "SBI General", None, None, None]


def test_a_shard_is_full_after_so_many_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SHARD_POSTINGS", 40)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 13)) + " the the") for i in range(400)], "id int, text string").coalesce(1)
    index = segments.SegmentedIndex(Tables(spark, str(tmp_path)), "id", "text", fan=2)
    for part in range(2):
        index.add(docs.filter(F.col("id") % 2 == part))
    assert len(index.segments()) == 1  # merged
    held = index.lists().groupBy("shard").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("n")).collect()
    assert len(held) >= 6 and max(r["n"] for r in held) <= 64 * 13  # checked every 64 documents
    want = search.postings(docs, "id", "text").select("doc_id", "term", "tf", "length")
    assert Counter(map(tuple, index.postings().collect())) == Counter(map(tuple, want.collect()))
    assert index.corpus().n_words == 400 * 14


def test_copies_of_a_question_and_distances_leave_in_bounded_parts():
    random = np.random.default_rng(3)
    centres = random.normal(size=(600, 4))
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(random.normal(size=(3000, 4)).tolist())], ["query_id", "embedding"])
    sent = list(vector_index._nearest_cells(centres, 500)([rows]))
    assert max(map(len, sent)) <= vector_index.PART_ROWS and sum(map(len, sent)) == 3000 * 500
    first = pa.Table.from_batches(sent).slice(0, 500)
    assert first["query_id"].to_pylist() == [0] * 500 and len(set(first["cell"].to_pylist())) == 500
    placed = list(vector_index._assign(centres)([rows]))
    assert max(map(len, placed)) <= vector_index.BLOCK_ROWS and pa.Table.from_batches(placed)["query_id"].to_pylist() == list(range(3000))
    assert pa.Table.from_batches(placed)["cell"][0] == first["cell"][0]


def test_postings_leave_many_lists_at_a_time(monkeypatch):
    """Shards follow each other, two of them mixed as after a clash of hashes; a list is longer than what is unpacked together."""
    monkeypatch.setattr(segments, "UNPACKED_ROWS", 700)
    ids = {"a": [7, 5, 9], "b": list(range(1000, 2500)), "c": [None, 1]}

    def packed(numbers):
        return np.array(numbers, np.int32).tobytes()

    heads = {s: (s, None, None, packed(range(3, 3 + len(ids[s]))), ids[s]) for s in ids}
    lists = {s: [(s, f"t{k}", packed([k % len(ids[s])]), packed([k + 1]), None) for k in range(1000)] for s in "ac"}
    lists["b"] = [("b", "all", packed(range(1500)), packed(range(1, 1501)), None)]
    mixed = [x for pair in zip(lists["a"], lists["c"], strict=True) for x in pair]
    laid = [heads["b"], *lists["b"], heads["a"], heads["c"], *mixed]
    schema = pa.schema([("shard", pa.string()), ("term", pa.string()), ("places", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def batches(some, size):
        whole = pa.RecordBatch.from_pydict({f.name: [x[i] for x in some] for i, f in enumerate(schema)}, schema)
        return [whole.slice(low, size) for low in range(0, len(whole), size)]

    want = [(ids["b"][p], "all", p + 1, p + 3) for p in range(1500)]
    want += [(ids[s][k % len(ids[s])], f"t{k}", k + 1, k % len(ids[s]) + 3) for k in range(1000) for s in "ac"]
    for size in (4000, 333):
        sent = list(segments._unpack(batches(laid, size)))
        assert sorted(map(repr, (tuple(r.values()) for x in sent for r in x.to_pylist()))) == sorted(map(repr, want))
    plain = list(segments._unpack(batches([heads["a"], *lists["a"]], 4000)))
    assert [len(x) for x in plain] == [700, 300]  # not a batch for each of 1,000 lists


def test_words_of_many_documents_are_counted_together(spark, tmp_path):
    texts = ["Été été ETE \U0001d4d0 ￮ z", "", None, "the the a", "x" * 300 + " the", "हिंदी a हिंदी"]
    docs = spark.createDataFrame([(i, texts[i % 6]) for i in range(600)], "id int, text string").coalesce(1)
    index = SegmentedIndex(Tables(spark, str(tmp_path)), "id", "text", shard_docs=150)
    index.add(docs)
    index.add(docs.filter("text is null"))  # known already
    want = search.postings(docs, "id", "text").select("doc_id", "term", "tf", "length")
    assert Counter(map(tuple, index.postings().collect())) == Counter(map(tuple, want.collect()))
    assert len(index.segments()) == 1 and index.corpus().n_docs == 600
    lists = index.lists().filter("term is not null")
    orders = lists.groupBy("shard").agg(F.collect_list("term").alias("t")).collect()
    assert len(orders) == 4 and all(r["t"] == sorted(r["t"]) for r in orders)
    top = lists.filter("term = 'the'").agg(F.max("most"), F.min("shortest"), F.sum("n")).first()
    assert tuple(top) == (2, 2, 200)


def test_words_of_a_lexicon_are_found_without_splitting_the_text(spark):
    lexicon = ("that", "thatin", "than", "don't", "x2", "é", "\U0001d4d0b")
    texts = [
        "that thatin xthat thatx that2 2that that_than THAT",
        "\U0001d400that \U0001f600that that\U0001f600 that\U0001d400",
        "that́ ́that",
        "don't x2 é éé \U0001d4d0b a\U0001d4d0b",
        "that\u0085that than",
        "thatthat than-than.than",
        "",
        None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(X.lexicon_words(F.lower("t"), lexicon).alias("found"), X.only(F.split(F.lower("t"), X.LETTERS), lexicon).alias("want")).collect()
    assert [r["found"] for r in found] == [r["want"] for r in found] and sum(len(r["found"] or []) for r in found) == 17
    assert rows.select(X.lexicon_words(F.col("t"), ()).alias("f")).first()["f"] == []
    ends = "Mr. A. b!\n\nc। d.e f.  \n g? \nh"
    old = r"\n|(?<=[.!?" + "।" + r"])(?<!\b(?:" + "|".join(X.ABBREVIATIONS) + r")\.)(?=\s)"
    split = spark.createDataFrame([(ends,)], "t string").select(F.split("t", X.SENTENCE_END).alias("a"), F.split("t", old).alias("b")).first()
    assert split["a"] == split["b"] and len(split["a"]) > 6
    plan = rows.select(X.marked_sentences("t", lexicon).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1  # into sentences only
