"""Metric layer over the scored 360 frame: named dimensions, measures and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import exact_avg


@dataclass(frozen=True)
class Measure:
    aggregation: str  # count, sum or avg
    column: str

    def expr(self) -> Column:
        if self.aggregation == "count":
            return F.count(self.column)
        if self.aggregation == "avg":
            return exact_avg(F.col(self.column))
        return F.sum(self.column)


def dimensions() -> dict[str, Column]:
    plain = (
        "customer_id", "age", "gender", "city", "state", "segment", "preferred_language", "risk_level", "risk_factors",
        "nearest_renewal_date", "competitors_named", "last_paid_date",
    )
    named = {name: F.col(name) for name in plain}
    named["customer_name"] = full_name()
    named["nearest_renewal"] = F.col("nearest_renewal_date")  # the time dimension
    return named


def full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


# Measures and their default aggregation.
MEASURES: dict[str, Measure] = {
    "customer_count": Measure("count", "customer_id"),
    "total_active_premium": Measure("sum", "total_active_premium"),
    "revenue_at_risk": Measure("sum", "revenue_at_risk"),
    "churn_risk_score": Measure("avg", "churn_risk_score"),
    "active_policies": Measure("sum", "active_policies"),
    "total_policies": Measure("sum", "total_policies"),
    "lapsed_cancelled_policies": Measure("sum", "lapsed_cancelled_policies"),
    "total_claims": Measure("sum", "total_claims"),
    "rejected_claims": Measure("sum", "rejected_claims"),
    "delayed_claims": Measure("sum", "delayed_claims"),
    "outstanding_claim_amount": Measure("sum", "outstanding_claim_amount"),
    "late_payment_count": Measure("sum", "late_payment_count"),
    "total_late_fees": Measure("sum", "total_late_fees"),
    "avg_sentiment": Measure("avg", "avg_sentiment"),
    "recent_avg_sentiment": Measure("avg", "recent_avg_sentiment"),
    "negative_interaction_count": Measure("sum", "negative_interaction_count"),
    "competitor_mention_count": Measure("sum", "competitor_mention_count"),
    "cancellation_intent_count": Measure("sum", "cancellation_intent_count"),
    "days_to_renewal": Measure("avg", "days_to_renewal"),
}


def filters() -> dict[str, Column]:
    c = F.col
    return {
        "critical_risk_only": c("risk_level") == "Critical",
        "high_risk_and_above": c("risk_level").isin("Critical", "High"),
        "has_competitor_mention": c("competitor_mention_count") > 0,
        "renewal_within_30_days": renewal_within(30),
        "has_late_payments": c("late_payment_count") > 0,
        "has_rejected_claims": c("rejected_claims") > 0,
    }


def renewal_within(days: int) -> Column:
    return F.col("days_to_renewal").isNotNull() & (F.col("days_to_renewal") <= days)


def apply_filters(frame: DataFrame, names: Sequence[str | Column]) -> DataFrame:
    known = filters()
    for f in names:
        frame = frame.filter(known[f] if isinstance(f, str) else f)
    return frame


def metric_query(
    frame: DataFrame,
    by: Mapping[str, str | Column] | Sequence[str] = (),
    measures: Mapping[str, str | Column] | Sequence[str] = ("customer_count",),
    where: Sequence[str | Column] = (),
    order_by: Sequence[str | Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """``filter -> group -> aggregate -> order -> limit`` in names.

    ``by`` and ``measures`` are registry names, or mappings from an output name to a
    registry name or a Column.
    """
    dims = dimensions()
    by = by if isinstance(by, Mapping) else {d: d for d in by}
    measures = measures if isinstance(measures, Mapping) else {m: m for m in measures}
    keys = [(dims[d] if isinstance(d, str) else d).alias(name) for name, d in by.items()]
    aggs = [(MEASURES[m].expr() if isinstance(m, str) else m).alias(name) for name, m in measures.items()]
    frame = apply_filters(frame, where)
    out = frame.groupBy(*keys).agg(*aggs) if keys else frame.agg(*aggs)
    if order_by:
        out = out.orderBy(*order_by)
    return out if limit is None else out.limit(limit)
