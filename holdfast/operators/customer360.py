"""One row per customer: policy, claim, payment and interaction aggregates on the customer spine.

Every fact table is aggregated before it is joined, so one-to-many joins cannot inflate
sums, each side of a join is unique on its key, and a hot customer is reduced by the
map-side partial aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import as_date, day_start, days_between, exact_avg, or_zero

RECENT_DAYS = 90
DELAY_DAYS = 30

SPINE = ("customer_id", "first_name", "last_name", "age", "gender", "city", "state", "segment", "preferred_language")
ZERO_DEFAULTS = {
    "policies": ("total_policies", "active_policies", "lapsed_cancelled_policies", "total_active_premium"),
    "claims": (
        "total_claims",
        "rejected_claims",
        "pending_claims",
        "delayed_claims",
        "outstanding_claims",
        "outstanding_claim_amount",
    ),
    "payments": ("total_payments", "late_payment_count", "total_late_fees"),
    "interactions": (
        "total_interactions",
        "avg_sentiment",
        "recent_avg_sentiment",
        "negative_interaction_count",
        "competitor_mention_count",
        "cancellation_intent_count",
        "churn_signal_count",
    ),
}


def policy_agg(policies: DataFrame, as_of: dt.date | str) -> DataFrame:
    status, end = F.col("status"), F.col("end_date")
    active = status == "Active"
    today = as_date(as_of)
    agg = policies.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_policies"),
        F.count_if(active).alias("active_policies"),
        F.count_if(status.isin("Lapsed", "Cancelled")).alias("lapsed_cancelled_policies"),
        F.sum(F.when(active, F.col("premium_amount")).otherwise(0)).cast("decimal(18,2)").alias("total_active_premium"),
        F.min(F.when(active & (end >= today), end)).alias("nearest_renewal_date"),
    )
    return agg.withColumn("days_to_renewal", days_between(today, "nearest_renewal_date"))


def claim_agg(claims: DataFrame, as_of: dt.date | str) -> DataFrame:
    status = F.col("status")
    delayed = (status == "Pending") & (days_between("claim_date", as_date(as_of)) > DELAY_DAYS)
    open_claim = status.isin("Pending", "Approved")
    return claims.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(status == "Rejected").alias("rejected_claims"),
        F.count_if(status == "Pending").alias("pending_claims"),
        F.count_if(delayed).alias("delayed_claims"),
        F.count_if(open_claim).alias("outstanding_claims"),
        F.sum(F.when(open_claim, F.col("claim_amount")).otherwise(0)).cast("decimal(18,2)").alias("outstanding_claim_amount"),
        F.sum(F.when(status == "Settled", F.col("approved_amount")).otherwise(0))
        .cast("decimal(18,2)")
        .alias("total_settled_amount"),
    )


def payment_agg(payments: DataFrame) -> DataFrame:
    status = F.col("status")
    return payments.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_payments"),
        F.count_if(status == "Paid").alias("paid_count"),
        F.count_if(status.isin("Overdue", "Failed")).alias("late_payment_count"),
        F.sum("late_fee").cast("decimal(18,2)").alias("total_late_fees"),
        F.max(F.when(status == "Paid", F.col("paid_date"))).alias("last_paid_date"),
    )


def interaction_agg(insights: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Counts, averages and competitor names from one scan.

    The rows shrink to one for each customer and competitor in a hash aggregate with exact sums; the second aggregate, which
    can't be one because it collects names, reads only those. Customer is a key of both, so a filter on it reaches the scan.
    """
    score, signal = F.col("sentiment_score"), F.col("churn_signal")
    recent = F.col("interaction_ts") >= day_start(as_of, RECENT_DAYS)
    fixed = score.cast("decimal(18,12)")
    parts = insights.groupBy("customer_id", "competitor").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(fixed).alias("score"),
        F.count(score).alias("scores"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        F.count_if(signal == "cancellation_intent").alias("cancel"),
        F.count_if(signal != "none").alias("signals"),
        F.sum(F.when(recent, fixed)).alias("recent_score"),
        F.count(F.when(recent, score)).alias("recent_scores"),
    )
    names = F.array_join(F.sort_array(F.collect_set("competitor")), ", ")  # bounded by the list of competitors
    return parts.groupBy("customer_id").agg(
        F.sum("rows").alias("total_interactions"),
        (F.sum("score").cast("double") / F.nullif(F.sum("scores"), F.lit(0))).alias("avg_sentiment"),
        F.sum("negative").alias("negative_interaction_count"),
        F.sum(F.when(F.col("competitor").isNotNull(), F.col("rows")).otherwise(0)).alias("competitor_mention_count"),
        F.sum("cancel").alias("cancellation_intent_count"),
        F.sum("signals").alias("churn_signal_count"),
        (F.sum("recent_score").cast("double") / F.nullif(F.sum("recent_scores"), F.lit(0))).alias("recent_avg_sentiment"),
        F.nullif(names, F.lit("")).alias("competitors_named"),
    )


def customer_360(
    customers: DataFrame,
    policies: DataFrame,
    claims: DataFrame,
    payments: DataFrame,
    insights: DataFrame,
    as_of: dt.date | str,
) -> DataFrame:
    """The unscored 360 frame: counts and sums default to 0; dates and names stay NULL."""
    joined = customers.select(*SPINE)
    for side in (
        policy_agg(policies, as_of),
        claim_agg(claims, as_of),
        payment_agg(payments),
        interaction_agg(insights, as_of),
    ):
        joined = joined.join(side, "customer_id", "left")
    zero = ZERO_DEFAULTS
    return joined.select(
        *SPINE,
        *[or_zero(c).alias(c) for c in zero["policies"]],
        "nearest_renewal_date",
        "days_to_renewal",
        *[or_zero(c).alias(c) for c in zero["claims"]],
        *[or_zero(c).alias(c) for c in zero["payments"]],
        "last_paid_date",
        *[or_zero(c).alias(c) for c in zero["interactions"]],
        "competitors_named",
        or_zero("total_active_premium").alias("revenue_at_risk"),
    )


def with_coverage(interactions: DataFrame) -> DataFrame:
    """One row: how many interactions carry a sentiment and a summary."""
    return interactions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("sentiment_score").alias("has_sentiment"),
        F.count("summary").alias("has_summary"),
        exact_avg(F.col("sentiment_score")).alias("avg_sentiment"),
    )
