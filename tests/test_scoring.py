from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from domain import AS_OF, days_ago, facts
from pyspark.sql import functions as F

from holdfast.functions.text import sentiment_label
from holdfast.operators.scorecard import risk_level, score_customers


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def scored(spark, **given):
    return one(score_customers(facts(spark, **given).frame(AS_OF)))


def test_nothing_known(spark):
    row = scored(spark)
    assert (row.churn_risk_score, row.risk_level, row.risk_factors) == (0, "Low", "")
    assert row.total_policies == row.total_claims == row.total_payments == row.total_interactions == 0
    assert row.nearest_renewal_date is None and row.last_paid_date is None and row.competitors_named is None


def test_caps(spark):
    row = scored(
        spark,
        payments=[{"customer_id": "C1", "status": "Overdue"}] * 6 + [{"customer_id": "C1", "status": "Failed"}] * 4,
        claims=[{"customer_id": "C1", "status": "Rejected"}] * 5
        + [{"customer_id": "C1", "status": "Pending", "claim_date": days_ago(50)}] * 5,
        insights=[{"customer_id": "C1", "competitor": "Acko"}] * 5,
    )
    assert (row.pts_late_payments, row.pts_rejected_claims, row.pts_outstanding_claims, row.pts_competitor) == (20, 15, 10, 10)
    assert (row.churn_risk_score, row.risk_level) == (55, "High")


def test_joins_do_not_inflate_premium(spark):
    row = scored(
        spark,
        policies=[{"customer_id": "C1"}] * 2 + [{"customer_id": "C1", "status": "Expired"}],
        payments=[{"customer_id": "C1"}] * 4,
        claims=[{"customer_id": "C1"}] * 2,
    )
    assert row.total_active_premium == Decimal("2000.00")
    assert (row.total_policies, row.total_payments, row.total_claims) == (3, 4, 2)


def test_half_point_rounds_up(spark):
    row = scored(spark, claims=[{"customer_id": "C1", "status": "Rejected"}])
    assert row.pts_rejected_claims == Decimal("7.5")
    assert (row.churn_risk_score, row.risk_level) == (8, "Low")
    assert row.risk_factors == "1 rejected claim(s) [+8pts]"


def test_delay_starts_after_thirty_days(spark):
    row = scored(
        spark,
        claims=[{"customer_id": "C1", "status": "Pending", "claim_date": days_ago(n)} for n in (30, 31)],
    )
    assert (row.pending_claims, row.delayed_claims) == (2, 1)


@pytest.mark.parametrize("days, points", [(0, 10), (30, 10), (31, 0), (-1, 0)])
def test_renewal_window(spark, days, points):
    row = scored(spark, policies=[{"customer_id": "C1", "end_date": AS_OF + dt.timedelta(days=days)}])
    assert row.pts_renewal_risk == points


def test_level_boundaries(spark):
    scores = spark.createDataFrame([(s,) for s in (9, 10, 29, 30, 59, 60)], "s int")
    levels = (("Critical", 60), ("High", 30), ("Medium", 10))
    found = [r[0] for r in scores.orderBy("s").select(risk_level("s", levels)).collect()]
    assert found == ["Low", "Medium", "Medium", "High", "High", "Critical"]


def test_sentiment_window(spark):
    def at(days):
        return dt.datetime.combine(days_ago(days), dt.time())

    row = scored(
        spark,
        insights=[
            {"customer_id": "C1", "interaction_ts": at(90), "sentiment_score": -0.5},
            {"customer_id": "C1", "interaction_ts": at(91), "sentiment_score": 1.0},
        ],
    )
    assert row.recent_avg_sentiment == -0.5
    assert row.avg_sentiment == 0.25
    assert row.pts_negative_sentiment == 10.0
    assert row.risk_factors == "Negative sentiment (avg -0.5) [+10pts]"


def test_label_boundaries(spark):
    scores = spark.createDataFrame([(0.2,), (-0.2,), (0.19,)], "s double")
    assert [r[0] for r in scores.select(sentiment_label("s")).collect()] == ["positive", "negative", "neutral"]


def test_explanation_lists_every_factor(spark):
    row = scored(
        spark,
        policies=[{"customer_id": "C1", "end_date": AS_OF + dt.timedelta(days=12)}, {"customer_id": "C1", "status": "Lapsed"}],
        payments=[{"customer_id": "C1", "status": "Overdue"}],
        insights=[
            {"customer_id": "C1", "competitor": "Digit", "churn_signal": "cancellation_intent"},
            {"customer_id": "C1", "competitor": "Acko"},
        ],
    )
    assert row.risk_factors == (
        "1 late payment(s) [+5pts] | 2 competitor mention(s): Acko, Digit [+10pts] | Cancellation intent expressed [+15pts]"
        " | Renewal in 12 days [+10pts] | 1 lapsed/cancelled policy(ies) [+5pts]"
    )
    assert row.churn_risk_score == 45


def test_result_does_not_depend_on_row_order(spark):
    given = facts(
        spark,
        customers=[f"C{i}" for i in range(20)],
        insights=[
            {"customer_id": f"C{i % 20}", "sentiment_score": -1 / (1 + i % 7), "competitor": "Acko" if i % 3 else None}
            for i in range(400)
        ],
    )
    frame = score_customers(given.frame(AS_OF)).orderBy("customer_id").collect()
    shuffled = type(given)(*[df.orderBy(F.rand(3)).repartition(7) for df in
                             (given.customers, given.policies, given.claims, given.payments, given.insights)])
    assert score_customers(shuffled.frame(AS_OF)).orderBy("customer_id").collect() == frame
