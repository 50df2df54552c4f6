from __future__ import annotations

import datetime as dt
from itertools import count

from domain import AS_OF, days_ago, facts, rows
from pyspark.sql import functions as F

from holdfast.functions.text import INSURANCE_RULES
from holdfast.operators import enrichment
from holdfast.operators import quality as Q
from holdfast.operators.pick import one_per_key
from holdfast.operators.scorecard import score_customers
from holdfast.operators.search import postings, search_documents
from holdfast.operators.segments import SegmentedIndex
from holdfast.plans import daily
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import fresh_dir, spread, subfolders
from holdfast.streaming import refresh
from holdfast.streaming.refresh import batch_step, maintain, new_in_batch

TEXTS = [
    "Thank you, great and quick service.",
    "I am unhappy, my claim is delayed. I may move to Acko.",
    "Please cancel my policy now, this is unacceptable.",
    "When is my premium due?",
    "  ",
]


def calls(spark, n, first=0):
    return rows(
        spark,
        "interactions",
        *[
            {
                "interaction_id": f"I{i:04d}",
                "customer_id": f"C{i % 5}",
                "content": TEXTS[i % len(TEXTS)] if i % 5 else TEXTS[0],
                "interaction_ts": dt.datetime(2025, 9, 1) + dt.timedelta(hours=i),
            }
            for i in range(first, n)
        ],
    )


def raw(spark, path):
    store = Tables(spark, str(path))
    given = facts(
        spark,
        customers=[f"C{i}" for i in range(5)],
        policies=[{"customer_id": f"C{i}", "end_date": AS_OF + dt.timedelta(days=i * 10)} for i in range(5)],
        claims=[{"customer_id": "C1", "status": "Pending", "claim_date": days_ago(30)}],
        payments=[{"customer_id": "C2", "status": "Overdue"}] * 2,
    )
    for name in ("customers", "policies", "claims", "payments"):
        store.replace(name, getattr(given, name))
    return store


def clock():
    ticks = count()
    return lambda: dt.datetime(2025, 9, 28, 2) + dt.timedelta(seconds=next(ticks))


def test_slices_equal_one_run(spark, tmp_path):
    one, many, now = raw(spark, tmp_path / "one"), raw(spark, tmp_path / "many"), clock()
    one.replace("interactions", calls(spark, 30))
    daily.run_daily(one, AS_OF, INSURANCE_RULES, clock=now)
    many.replace("interactions", calls(spark, 10))
    daily.run_daily(many, AS_OF, INSURANCE_RULES, clock=now)
    many.append("interactions", calls(spark, 30, first=10))
    entry = daily.run_daily(many, AS_OF, INSURANCE_RULES, clock=now)
    assert (entry["status"], entry["new_interactions"], entry["enriched_count"]) == ("COMPLETED", 16, 16)
    drop = ("enriched_at",)
    a, b = one.read(daily.INSIGHTS).drop(*drop), many.read(daily.INSIGHTS).drop(*drop)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a, b = daily.scored_snapshot(one), daily.scored_snapshot(many)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert all(r.passed for r in Q.insight_checks(many.read(daily.INSIGHTS), calls(spark, 30)).collect())


def test_blank_texts_do_not_keep_the_run_busy(spark, tmp_path):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 10))
    first = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert first["details"].startswith("8 new interactions, 2 without text.")
    again = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert again["details"] == "No new interactions. Skipped." and again["new_interactions"] == 0
    assert store.read(daily.LOG).count() == 2
    filled = daily.current_interactions(store)
    assert filled.filter(F.col("sentiment_score").isNotNull()).count() == 8


def test_quiet_day_moves_the_snapshot(spark, tmp_path):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 5))
    daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    later = AS_OF + dt.timedelta(days=2)
    entry = daily.run_daily(store, later, INSURANCE_RULES, clock=now)
    assert entry["details"] == "No new interactions. Skipped."
    full = daily.read_facts(store).frame(later)
    snapshot = daily.snapshot(store)
    assert full.exceptAll(snapshot).count() == 0 and snapshot.exceptAll(full).count() == 0
    delayed = snapshot.filter("customer_id = 'C1'").first()["delayed_claims"]
    assert delayed == 1  # the claim was 30 days old before


def test_failed_step_is_recorded_and_the_rest_runs(spark, tmp_path, monkeypatch):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 10))
    daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    store.append("interactions", calls(spark, 12, first=10))

    def broken(*_):
        raise RuntimeError("model is away")

    monkeypatch.setattr(daily, "enrich_new", broken)
    entry = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert entry["status"] == "PARTIAL_FAIL" and entry["error_message"] == "Enrichment: model is away"
    assert "360 refreshed." in entry["details"] and entry["enriched_count"] == 0
    monkeypatch.undo()
    entry = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert (entry["status"], entry["enriched_count"]) == ("COMPLETED", 2)


def test_crash_before_the_snapshot_is_caught_up(spark, tmp_path, monkeypatch):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 10))
    daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    store.append("interactions", calls(spark, 20, first=10))
    daily.enrich_new(store, INSURANCE_RULES, now())  # the run died right after this
    entry = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert entry["status"] == "COMPLETED" and "360 refreshed." in entry["details"]
    full = daily.read_facts(store).frame(AS_OF)
    snapshot = daily.snapshot(store)
    assert full.exceptAll(snapshot).count() == 0 and snapshot.exceptAll(full).count() == 0


def same_as_rebuild(store, as_of):
    full = daily.read_facts(store).frame(as_of)
    snapshot = daily.snapshot(store)
    return full.exceptAll(snapshot).count() == 0 and snapshot.exceptAll(full).count() == 0


def test_a_change_writes_the_changed_rows_only(spark, tmp_path):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 10))
    daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    first = store._batches(daily.SNAPSHOT)
    assert len(first) == 1
    for day in range(1, 12):  # more changes than a version takes batches
        store.append("payments", facts(spark, payments=[{"payment_id": f"N{day}", "customer_id": "C3", "status": "Overdue"}]).payments)
        daily.refresh(store, AS_OF)
        assert same_as_rebuild(store, AS_OF)
        version, batch = store._batches(daily.SNAPSHOT)[-1]
        assert store._read(daily.SNAPSHOT, [(version, batch)]).count() == (1 if batch > 1 else 5)
    versions = {v for v, _ in store._batches(daily.SNAPSHOT)}
    assert len(versions) == 2 and max(versions) == 2
    before = store._batches(daily.SNAPSHOT)
    daily.refresh(store, AS_OF + dt.timedelta(days=1))  # nothing but the countdown moves
    assert store._batches(daily.SNAPSHOT) == before and same_as_rebuild(store, AS_OF + dt.timedelta(days=1))


def test_any_change_reaches_the_snapshot(spark, tmp_path):
    store, now = raw(spark, tmp_path), clock()
    store.replace("interactions", calls(spark, 10))
    daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    more = facts(spark, customers=["C8", "C9"], policies=[{"customer_id": "C8"}], payments=[{"customer_id": "C3", "status": "Overdue"}])
    for name in ("customers", "policies", "payments"):
        store.append(name, getattr(more, name))
    entry = daily.run_daily(store, AS_OF, INSURANCE_RULES, clock=now)
    assert entry["status"] == "COMPLETED" and entry["enriched_count"] == 0
    assert same_as_rebuild(store, AS_OF) and store.read(daily.SNAPSHOT).count() == 7
    store.replace("payments", store.read("payments").filter("customer_id <> 'C2'"))  # a correction of old rows
    daily.refresh(store, AS_OF)
    assert same_as_rebuild(store, AS_OF)
    daily.refresh(store, days_ago(40))  # back in time
    assert same_as_rebuild(store, days_ago(40))


def test_late_stamps_and_repeated_ids(spark, tmp_path):
    store = raw(spark, tmp_path)
    store.replace("interactions", calls(spark, 10).unionByName(calls(spark, 6)))
    daily.enrich_new(store, INSURANCE_RULES, dt.datetime(2025, 9, 28))
    daily.refresh(store, AS_OF)
    store.append("interactions", calls(spark, 20, first=10).unionByName(calls(spark, 14, first=10)))
    daily.enrich_new(store, INSURANCE_RULES, dt.datetime(2025, 9, 1))  # a clock set back
    daily.refresh(store, AS_OF)
    insights = store.read(daily.INSIGHTS)
    assert insights.count() == insights.select("interaction_id").distinct().count() == 16
    assert same_as_rebuild(store, AS_OF)
    assert daily.current_interactions(store).count() == store.read("interactions").count()


def test_refresh_over_a_day_boundary(spark):
    given = facts(
        spark,
        customers=["C1", "C2", "C3", "C4"],
        policies=[
            {"customer_id": "C1", "end_date": AS_OF},
            {"customer_id": "C1", "end_date": AS_OF + dt.timedelta(days=50)},
            {"customer_id": "C4", "end_date": AS_OF + dt.timedelta(days=35)},
        ],
        claims=[{"customer_id": "C2", "status": "Pending", "claim_date": days_ago(28)}],
        insights=[{"customer_id": "C3", "interaction_ts": dt.datetime.combine(days_ago(88), dt.time()), "sentiment_score": -0.4}],
    )
    later = AS_OF + dt.timedelta(days=5)
    before, full = given.frame(AS_OF), given.frame(later)
    affected = daily.affected_customers(before, given, [], AS_OF, later)
    assert sorted(r.customer_id for r in affected.collect()) == ["C1", "C2", "C3"]
    fresh = daily.refresh_snapshot(before, given, affected, later)
    assert full.exceptAll(fresh).count() == 0 and fresh.exceptAll(full).count() == 0
    assert score_customers(full).filter("customer_id = 'C4'").first().pts_renewal_risk == 10


def test_stream_maintains_insights_and_snapshot(spark, tmp_path):
    store = raw(spark, tmp_path / "store")
    landing = str(tmp_path / "landing")
    calls(spark, 12).coalesce(1).write.mode("append").parquet(landing)

    def run():
        source = spark.readStream.schema(calls(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(landing)
        query = maintain(source, store, INSURANCE_RULES, str(tmp_path / "state"), as_of=AS_OF)
        query.awaitTermination()

    run()
    calls(spark, 25, first=6).coalesce(1).write.mode("append").parquet(landing)  # overlaps the first file
    run()
    insights = store.read(daily.INSIGHTS)
    assert insights.count() == insights.select("interaction_id").distinct().count() == 20
    full = daily.read_facts(store).frame(AS_OF)
    snapshot = daily.snapshot(store)
    assert full.exceptAll(snapshot).count() == 0
    # A replayed batch adds nothing.
    batch_step(store, INSURANCE_RULES, AS_OF)(calls(spark, 25), 0)
    assert store.read(daily.INSIGHTS).count() == 20


def joined_by_shuffle(df):
    """Whether the plan sorts both sides of a join, so that rows with all their columns move."""
    return "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_only_keys_move_to_find_new_rows(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    many = calls(spark, 400).withColumn("content", F.concat("content", F.lit(" "), F.sha2("interaction_id", 512)))
    raw = store.replace("interactions", many.unionByName(many.limit(3)).unionByName(many.limit(1).withColumn("interaction_id", F.lit(None).cast("string"))))
    done = store.replace("done", many.filter("interaction_id < 'I0390' and interaction_id <> 'I0001'"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # the texts are larger, a few keys are smaller
    try:
        new = enrichment.unprocessed_rows(raw, done)
        once = one_per_key(new, "interaction_id")
        assert not joined_by_shuffle(new) and not joined_by_shuffle(once)
        want = sorted([*(f"I{i:04d}" for i in range(390, 400)), *["I0001"] * 2, ""])
        assert sorted(r.interaction_id or "" for r in new.collect()) == want
        assert sorted(r.interaction_id or "" for r in once.collect()) == sorted({*want})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_even_splits_are_not_shuffled(spark, tmp_path):
    even, uneven = str(tmp_path / "even"), str(tmp_path / "uneven")
    spark.range(0, 8000, 1, 8).write.parquet(even)
    spark.range(0, 8000, 1, 8).coalesce(1).write.parquet(uneven)
    assert "Exchange" not in spread(spark.read.parquet(even), "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.read.parquet(uneven), "id", 8).rdd.getNumPartitions() == 8
    assert spread(spark.read.parquet(even).limit(0), "id", 4).count() == 0


def test_only_keys_move_to_find_the_new_rows_of_a_batch(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    many = calls(spark, 400).withColumn("content", F.concat("content", F.lit(" "), F.sha2("interaction_id", 512)))
    batch = store.replace("batch", many.unionByName(many.limit(3)))
    done = store.replace("done", many.filter("interaction_id < 'I0010'"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # the texts are larger, a few keys are smaller
    try:
        new = new_in_batch(batch, done)
        assert not joined_by_shuffle(new)
        assert sorted(r.interaction_id for r in new.collect()) == [f"I{i:04d}" for i in range(10, 400)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_batch_writes_its_texts_once_for_insights_and_index(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(refresh, "fresh_dir", lambda session, label: made.append(fresh_dir(session, label)) or made[-1])
    store, given = Tables(spark, str(tmp_path / "store")), calls(spark, 40)
    index = SegmentedIndex(store, "interaction_id", "search_text", ["churn_signal"])
    step = batch_step(store, INSURANCE_RULES, None, index=index)
    nameless = given.limit(1).withColumn("interaction_id", F.lit(None).cast("string"))
    parts = [given.filter("interaction_id < 'I0020'").unionByName(given.limit(4)).unionByName(nameless), given.filter("interaction_id >= 'I0010'")]
    for number, part in enumerate(parts):
        made.clear()
        step(Tables(spark, str(tmp_path / "landed")).append("batch", part.withColumn("part", F.lit(number))).filter(F.col("part") == number).drop("part"), number)
        assert len(made) == 1 and not subfolders(spark, made[0])  # and keeps no copy
    step(parts[1], 2)  # replayed
    insights = store.read(daily.INSIGHTS)
    assert "content" not in insights.columns and insights.filter("interaction_id is null").count() == 1
    want = postings(search_documents(given, insights), "interaction_id", "search_text").select("doc_id", "term", "tf", "length")
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, want.collect()))
    assert index.corpus().n_docs == 32 and insights.count() == 33
