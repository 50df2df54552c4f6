from __future__ import annotations

import datetime as dt
from decimal import Decimal

from domain import AS_OF, days_ago, facts, rows
from pyspark.sql import functions as F

from holdfast.operators import decisions, ids, nba
from holdfast.operators import quality as Q
from holdfast.operators.scorecard import score_customers


def engine(spark, **given):
    inputs = facts(spark, **given)
    scored = score_customers(inputs.frame(AS_OF))
    return nba.recommend(scored, inputs.claims, inputs.insights, AS_OF).orderBy("recommendation_id").collect()


def late(customer, n):
    return [{"customer_id": customer, "status": "Overdue", "late_fee": Decimal("12.50")}] * n


def test_oldest_pending_claim_wins(spark):
    claims = [
        {"customer_id": "C1", "claim_id": "K1", "status": "Pending", "claim_date": days_ago(40)},
        {"customer_id": "C1", "claim_id": "K2", "status": "Pending", "claim_date": days_ago(50)},
    ]
    (row,) = engine(spark, claims=claims, payments=late("C1", 3), policies=[{"customer_id": "C1"}])
    assert row.action_code == "CLAIM_ESCALATION"
    assert row.recommended_action == "Escalate claim K2 (Theft, Rs. 500.00) pending 50 days"


def test_review_needs_a_complaint(spark):
    claims = [{"customer_id": "C1", "claim_id": "K1", "status": "Rejected", "rejection_reason": "late"}]
    assert engine(spark, claims=claims) == []
    complaint = {
        "customer_id": "C1",
        "interaction_id": "I9",
        "primary_intent": "complaint",
        "churn_signal": "claim_delay",
        "key_quote": "Why?",
        "sentiment_score": -0.05,
    }
    (row,) = engine(spark, claims=claims, insights=[complaint])
    assert row.action_code == "CLAIM_REVIEW"
    assert row.supporting_evidence == 'Claim K1 rejected: late. Complaint interaction I9. Quote: "Why?"'


def test_discount_cap(spark):
    premiums = spark.createDataFrame([(Decimal("26260.00"),), (Decimal("81590.00"),)], "total_active_premium decimal(18,2)")
    assert [r[0] for r in premiums.select(nba.discount_amount()).collect()] == [Decimal("3939.00"), Decimal("10000.00")]


def test_discount_above_cap_is_flagged(spark):
    made = spark.createDataFrame(
        [("RETENTION_DISCOUNT", Decimal("10001"), Decimal("0.80")), ("PAYMENT_PLAN", None, Decimal("0.59"))],
        "action_code string, discount_amount decimal(12,2), confidence_score decimal(4,2)",
    )
    found = made.select(nba.compliance_status(), nba.review_reason()).collect()
    assert [tuple(r) for r in found] == [
        ("FLAGGED", "Discount exceeds cap"),
        ("NEEDS_HUMAN_REVIEW", "Confidence below threshold"),
    ]


def test_confidence_of_exactly_the_threshold_is_compliant(spark):
    # Payment plan, no interactions, three factors: 0.70 + 0.10 - 0.20.
    (row,) = engine(
        spark,
        policies=[{"customer_id": "C1"}],
        payments=late("C1", 2),
        claims=[{"customer_id": "C1", "status": "Rejected"}, {"customer_id": "C1", "status": "Pending", "claim_date": days_ago(5)}],
    )
    assert row.action_code == "PAYMENT_PLAN" and row.confidence_score == Decimal("0.50")
    frame = spark.createDataFrame(
        [("PAYMENT_PLAN", 0, 2, 1, 0, 0, 1, 0, 0.0, 0)],
        "action_code string, churn_signal_count int, late_payment_count int, rejected_claims int, competitor_mention_count int,"
        "cancellation_intent_count int, delayed_claims int, negative_interaction_count int, avg_sentiment double, total_interactions int",
    ).withColumn("confidence_score", nba.confidence())
    found = frame.withColumn("discount_amount", F.lit(None).cast("decimal(12,2)")).select(
        "confidence_score", nba.compliance_status().alias("status")
    )
    assert tuple(found.first()) == (Decimal("0.60"), "COMPLIANT")


def test_weak_callback_goes_to_review(spark):
    (row,) = engine(
        spark,
        policies=[{"customer_id": "C1", "status": "Lapsed"}],
        insights=[{"customer_id": "C1", "sentiment_label": "negative", "sentiment_score": -0.5, "churn_signal": "price_shock"}],
    )
    assert row.action_code == "PROACTIVE_CALLBACK"
    assert (row.confidence_score, row.compliance_status) == (Decimal("0.55"), "NEEDS_HUMAN_REVIEW")


def test_unknown_action_has_no_confidence(spark):
    made = spark.range(1).select(
        F.lit("SOMETHING").alias("action_code"),
        *[
            F.lit(1).alias(n)
            for n in (
                "churn_signal_count", "late_payment_count", "rejected_claims", "competitor_mention_count",
                "cancellation_intent_count", "delayed_claims", "negative_interaction_count", "avg_sentiment", "total_interactions",
            )
        ],
    )
    assert made.select(nba.confidence()).first()[0] is None


def test_sensitive_attributes_do_not_matter(spark):
    customers = [
        {"customer_id": f"C{i}", "age": 20 + i, "gender": "Female" if i % 2 else "Male", "preferred_language": "Hindi"} for i in range(6)
    ]
    inputs = facts(
        spark,
        customers=customers,
        policies=[{"customer_id": f"C{i}"} for i in range(6)],
        payments=[p for i in range(6) for p in late(f"C{i}", i)],
    )
    scored = score_customers(inputs.frame(AS_OF))
    assert nba.best_actions(scored, inputs.claims, inputs.insights, AS_OF).count() > 0
    with_all = nba.best_actions(scored, inputs.claims, inputs.insights, AS_OF).orderBy("customer_id").collect()
    without = nba.best_actions(scored.drop(*Q.SENSITIVE), inputs.claims, inputs.insights, AS_OF).orderBy("customer_id").collect()
    assert with_all == without
    assert all(r.passed for r in Q.fairness_check(scored).collect())
    swapped = {r.customer_id: (r.age, r.gender) for r in Q.with_others_attributes(scored).collect()}
    assert swapped["C0"] == (21, "Female") and swapped["C3"] == (24, "Male") and swapped["C5"] == (20, "Male")

    def unfair(frame):
        return nba.best_actions(frame.filter("age < 24"), inputs.claims, inputs.insights, AS_OF)

    assert not any(r.passed for r in Q.fairness_check(scored, unfair).collect())


def test_ids_widen_and_stay_unique(spark):
    numbered = ids.with_ids(spark.range(100_500), [F.col("id").desc()], "rec", "NBA")
    assert numbered.select("rec").distinct().count() == 100_500
    assert numbered.filter("id = 499").first()["rec"] == "NBA100001"
    assert numbered.filter("id = 100499").first()["rec"] == "NBA00001"
    assert numbered.agg(F.max(F.length("rec"))).first()[0] == 9
    assert numbered.select(ids.highest_number(numbered, "rec", "NBA")).first()[0] == 100_500


def test_edit_changes_the_action_and_approval_does_not(spark):
    recs = spark.createDataFrame(
        [("NBA00001", "C1", "PAYMENT_PLAN", "Offer plan"), ("NBA00002", "C2", "PAYMENT_PLAN", "Offer plan")],
        "recommendation_id string, customer_id string, action_code string, recommended_action string",
    )
    at = dt.datetime(2025, 9, 28, 10)
    batch = decisions.one_decision(spark, "NBA00001", "Edit", "lead", at, edited_action="Call first").unionByName(
        decisions.one_decision(spark, "NBA00002", "Approve", "lead", at, edited_action="ignored", manager_notes="")
    )
    log = decisions.record_decisions(recs, batch)
    found = {r.recommendation_id: r for r in log.collect()}
    assert (found["NBA00001"].decision, found["NBA00001"].final_action) == ("EDIT", "Call first")
    assert (found["NBA00002"].final_action, found["NBA00002"].manager_notes) == ("Offer plan", None)
    again = decisions.record_decisions(recs, batch)
    assert sorted(r.log_id for r in again.collect()) == sorted(r.log_id for r in found.values())
    assert decisions.pending(recs, log).count() == 0


def test_callbacks_continue_the_ids(spark):
    inputs = facts(
        spark,
        customers=["C1", "C2", "C3"],
        policies=[{"customer_id": c, "status": "Lapsed"} for c in ("C1", "C2", "C3")],
        insights=[
            {"customer_id": c, "sentiment_label": "negative", "sentiment_score": -0.9, "churn_signal": "price_shock"} for c in ("C1", "C2", "C3")
        ],
    )
    scored = score_customers(inputs.frame(AS_OF))
    known = spark.createDataFrame([("NBA00041", "C2")], "recommendation_id string, customer_id string")
    found = nba.daily_callbacks(scored, inputs.insights, known).orderBy("recommendation_id").collect()
    assert [(r.recommendation_id, r.customer_id) for r in found] == [("NBA00042", "C1"), ("NBA00043", "C3")]
    assert rows(spark, "claims").count() == 0


def test_claim_references_read_each_evidence_once(spark, tmp_path):
    claims = [("C1", "Pending"), ("C2", "Rejected"), ("C2", "Pending"), (None, "Pending"), ("C3", "Settled")]
    spark.createDataFrame(claims, "customer_id string, status string").write.parquet(str(tmp_path / "claims"))
    insights = spark.createDataFrame([("C2", "complaint", "claim_delay"), ("C1", "general", "none")], "customer_id string, primary_intent string, churn_signal string")
    chosen = [("C1", "CLAIM_ESCALATION"), ("C3", "CLAIM_ESCALATION"), ("C3", "CLAIM_ESCALATION"), (None, "CLAIM_ESCALATION")]
    chosen += [("C2", "CLAIM_REVIEW"), ("C1", "CLAIM_REVIEW"), (None, "CLAIM_REVIEW"), ("C3", "PAYMENT_PLAN")]
    made = Q.claim_reference_checks(
        spark.createDataFrame(chosen, "customer_id string, action_code string"), spark.read.parquet(str(tmp_path / "claims")), insights
    )
    assert {r.check: (r.expected, r.actual, r.passed) for r in made.collect()} == {
        "escalation has pending claim": (0, 3, False),
        "review has rejected claim": (0, 2, False),
        "review has complaint": (0, 2, False),
    }
    assert made._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
