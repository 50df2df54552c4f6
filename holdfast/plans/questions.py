"""The portfolio's standing questions: verified queries, dashboard tiles, customer workspace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import label_ranges, map_value, multi_filter, split_items
from holdfast.operators.pick import group_arrays, top_per_key
from holdfast.plans.metrics import full_name, metric_query, renewal_within

AT_RISK = ("Critical", "High")
_LEVEL_ORDER = {"Critical": 1, "High": 2, "Medium": 3}


def _by_score() -> list[Column]:
    return [F.col("churn_risk_score").desc(), F.col("customer_id")]


def _money(column: str) -> Column:
    return F.sum(column).cast("decimal(18,2)")


def _mean_score() -> Column:
    # Integer scores, so the sum and with it the mean are exact.
    return F.round(F.avg("churn_risk_score"), 1)


# --- verified queries ------------------------------------------------------------------------------


def high_risk_customer_count(frame: DataFrame) -> DataFrame:
    return metric_query(
        frame, ["risk_level"], where=["high_risk_and_above"], order_by=[F.col("customer_count").desc(), "risk_level"]
    )


def revenue_at_risk_by_level(frame: DataFrame) -> DataFrame:
    return metric_query(
        frame,
        ["risk_level"],
        {"customers": "customer_count", "total_revenue_at_risk": _money("revenue_at_risk")},
        order_by=[F.col("total_revenue_at_risk").desc(), "risk_level"],
    )


def riskiest_customers(frame: DataFrame, n: int = 10) -> DataFrame:
    return (
        frame.select(
            "customer_id", full_name().alias("name"), "city", "segment", "churn_risk_score", "risk_level", "revenue_at_risk", "risk_factors"
        )
        .orderBy(*_by_score())
        .limit(n)
    )


def churn_risk_by_city(frame: DataFrame) -> DataFrame:
    return metric_query(
        frame,
        ["city"],
        {"customers": "customer_count", "avg_risk_score": _mean_score(), "revenue_at_risk": _money("revenue_at_risk")},
        order_by=[F.col("avg_risk_score").desc(), "city"],
    )


def competitor_mention_summary(frame: DataFrame) -> DataFrame:
    return metric_query(
        frame,
        ["risk_level"],
        {
            "customers": "customer_count",
            "total_mentions": "competitor_mention_count",
            "avg_risk_score": _mean_score(),
            "revenue_at_risk": _money("revenue_at_risk"),
        },
        where=["has_competitor_mention"],
        order_by=[F.col("revenue_at_risk").desc(), "risk_level"],
    )


def segment_risk_breakdown(frame: DataFrame) -> DataFrame:
    return metric_query(
        frame,
        ["segment"],
        {
            "customers": "customer_count",
            "at_risk": F.count_if(F.col("risk_level").isin(*AT_RISK)),
            "avg_risk_score": _mean_score(),
            "total_premium": _money("total_active_premium"),
        },
        order_by=[F.col("avg_risk_score").desc(), "segment"],
    )


def renewal_risk_customers(frame: DataFrame, days: int = 30) -> DataFrame:
    return (
        frame.filter(renewal_within(days) & F.col("risk_level").isin(*AT_RISK))
        .select(
            "customer_id", full_name().alias("name"), "nearest_renewal_date", "days_to_renewal", "churn_risk_score",
            "risk_level", "total_active_premium", "risk_factors",
        )
        .orderBy(*_by_score())
    )


def late_payment_bucket() -> Column:
    n = F.col("late_payment_count")
    return label_ranges([(n == 0, "0 late"), (n.between(1, 3), "1-3 late"), (n.between(4, 6), "4-6 late")], "7+ late")


def sentiment_bucket() -> Column:
    s = F.col("recent_avg_sentiment")
    return label_ranges([(s >= 0.2, "Positive"), (s <= -0.2, "Negative")], "Neutral")


def _by_bucket(frame: DataFrame, name: str, bucket: Column) -> DataFrame:
    return metric_query(
        frame,
        {name: bucket},
        {"customers": "customer_count", "avg_risk_score": _mean_score(), "revenue_at_risk": _money("revenue_at_risk")},
        order_by=[F.col("avg_risk_score").desc(), name],
    )


def late_payment_impact(frame: DataFrame) -> DataFrame:
    return _by_bucket(frame, "late_payment_bucket", late_payment_bucket())


def sentiment_vs_churn(frame: DataFrame) -> DataFrame:
    return _by_bucket(frame, "sentiment_bucket", sentiment_bucket())


def critical_customers(frame: DataFrame) -> DataFrame:
    return (
        frame.filter(F.col("risk_level") == "Critical")
        .select(
            "customer_id", full_name().alias("name"), "city", "segment", "churn_risk_score", "active_policies",
            "total_active_premium", "late_payment_count", "rejected_claims", "competitor_mention_count", "competitors_named",
            "risk_factors",
        )
        .orderBy(*_by_score())
    )


# --- dashboard -------------------------------------------------------------------------------------

Selections = Mapping[str, Sequence[str]]


def kpi_row(frame: DataFrame, selections: Selections | None = None) -> DataFrame:
    return multi_filter(frame, selections or {}).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("risk_level").isin(*AT_RISK)).alias("at_risk"),
        _money("revenue_at_risk").alias("total_revenue"),
        _mean_score().alias("avg_risk"),
    )


def risk_distribution(frame: DataFrame, selections: Selections | None = None) -> DataFrame:
    return (
        multi_filter(frame, selections or {})
        .groupBy("risk_level")
        .agg(F.count(F.lit(1)).alias("customers"), _money("revenue_at_risk").alias("premium"))
        .orderBy(map_value("risk_level", _LEVEL_ORDER, 4))
    )


def dashboard_customers(frame: DataFrame, selections: Selections | None = None, n: int = 50) -> DataFrame:
    return (
        multi_filter(frame, selections or {})
        .select(
            "customer_id",
            full_name().alias("name"),
            "city",
            "segment",
            "risk_level",
            F.col("churn_risk_score").alias("score"),
            F.col("total_active_premium").alias("premium"),
            F.col("late_payment_count").alias("late_pay"),
            F.col("rejected_claims").alias("rej_claims"),
            F.col("competitor_mention_count").alias("comp_mentions"),
        )
        .orderBy(F.col("score").desc(), "customer_id")
        .limit(n)
    )


# --- customer workspace ----------------------------------------------------------------------------


def customer_lookup(frame: DataFrame, customer_id) -> DataFrame:
    """One customer's row. The key filter reaches the scan of every input of the 360 frame."""
    wanted = customer_id.upper() if isinstance(customer_id, str) else customer_id
    return frame.filter(F.col("customer_id") == F.lit(wanted))


def customer_policies(policies: DataFrame, customer_id) -> DataFrame:
    return (
        customer_lookup(policies, customer_id)
        .select(
            "policy_id", "product_type", F.concat("vehicle_make", F.lit(" "), "vehicle_model").alias("vehicle"), "premium_amount",
            "status", "start_date", "end_date",
        )
        .orderBy(F.col("start_date").desc(), "policy_id")
    )


def customer_claims(claims: DataFrame, customer_id) -> DataFrame:
    return (
        customer_lookup(claims, customer_id)
        .select("claim_id", "category", "claim_amount", "status", "claim_date", "resolution_date", "rejection_reason")
        .orderBy(F.col("claim_date").desc(), "claim_id")
    )


_PAYMENT_TAB = ("payment_id", "policy_id", "amount", "status", "due_date", "paid_date", "payment_method", "late_fee")


def customer_payments(payments: DataFrame, customer_id, n: int = 20) -> DataFrame:
    return (
        customer_lookup(payments, customer_id).select(*_PAYMENT_TAB).orderBy(F.col("due_date").desc(), "payment_id").limit(n)
    )


def latest_payments(payments: DataFrame, n: int = 20) -> DataFrame:
    """The payments tab for every customer at once."""
    order = [F.col("due_date").desc(), F.col("payment_id")]
    return top_per_key(payments.select("customer_id", *_PAYMENT_TAB), ["customer_id"], order, n, rank="recency")


def _interaction_tab() -> list:
    return [
        "interaction_id", "channel", "sentiment_label", "primary_intent", "churn_signal", "competitor",
        F.left("summary", F.lit(200)).alias("summary"), F.left("key_quote", F.lit(200)).alias("key_quote"),
    ]


def customer_interactions(insights: DataFrame, customer_id, n: int = 10) -> DataFrame:
    latest = customer_lookup(insights, customer_id).orderBy(F.col("interaction_ts").desc(), F.col("interaction_id").desc()).limit(n)
    return latest.select(*_interaction_tab())


def latest_interactions(insights: DataFrame, n: int = 10) -> DataFrame:
    """The interactions tab for every customer at once."""
    order = [F.col("interaction_ts").desc(), F.col("interaction_id").desc()]
    return top_per_key(insights, ["customer_id"], order, n, rank="recency").select("customer_id", "recency", *_interaction_tab())


def high_value_renewals(frame: DataFrame, days: int, min_premium) -> DataFrame:
    """Customers with a renewal within ``days`` and at least ``min_premium`` of active premium."""
    return (
        frame.filter(renewal_within(days) & (F.col("total_active_premium") >= F.lit(min_premium)))
        .select("customer_id", full_name().alias("name"), "days_to_renewal", "total_active_premium", "churn_risk_score", "risk_level")
        .orderBy(F.col("total_active_premium").desc(), "customer_id")
    )


def competitor_mentions(insights: DataFrame, competitor: str, limit: int = 10_000) -> DataFrame:
    """Customers who named a competitor, with their interaction ids as sorted arrays."""
    named = insights.filter(F.col("competitor") == competitor)
    return group_arrays(named, "customer_id", "interaction_id", [], F.col("interaction_id"), "interaction_ids", limit)


def risk_drivers(frame: DataFrame) -> DataFrame:
    """One row per customer and risk driver, in the order of the scorecard."""
    items = F.posexplode(split_items("risk_factors")).alias("at", "driver")
    return frame.select("customer_id", "churn_risk_score", "risk_level", items).withColumn("at", F.col("at") + 1)


def driver_frequency(frame: DataFrame) -> DataFrame:
    """How many customers each kind of driver touches; numbers and names inside the text are left out."""
    kind = F.trim(F.regexp_replace(F.regexp_replace("driver", r":.*$|\(avg.*$| \[\+.*$", ""), r"[0-9]+ ?", ""))
    return risk_drivers(frame).groupBy(kind.alias("driver_kind")).agg(F.count(F.lit(1)).alias("customers"))
