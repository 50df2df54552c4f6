"""Explainable scorecards: capped factors, a bounded total, levels and reasons.

A factor is data: points as a Column over the 360 frame and the text printed when it
scores. One pass of projections evaluates a whole card.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import as_date, day_start, days_between, exact_avg, int_text, number_text, or_zero


@dataclass(frozen=True)
class Factor:
    """``text`` receives the points column, so it can print them."""

    name: str
    points: Column
    text: object  # Callable[[Column], Column] or None


@dataclass(frozen=True)
class Scorecard:
    factors: Sequence[Factor]
    levels: Sequence[tuple[str, int]]  # (label, minimum score), highest first
    lowest: str = "Low"
    cap: int = 100
    separator: str = " | "
    round_total: bool = True
    score: str = "churn_risk_score"
    level: str = "risk_level"
    reasons: str = "risk_factors"
    keep_points: bool = field(default=True)


def risk_level(score: str | Column, levels: Sequence[tuple[str, int]], lowest: str = "Low") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    out = None
    for label, minimum in levels:
        cond = score >= minimum
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(lowest)


def apply_scorecard(df: DataFrame, card: Scorecard) -> DataFrame:
    """Add the points of every factor, the score, the level and the joined reasons."""
    scored = df.withColumns({f.name: f.points for f in card.factors})
    total = F.lit(0.0)
    for f in card.factors:
        total = total + F.col(f.name).cast("double")
    if card.round_total:
        total = F.round(total, 0)
    score = F.least(F.lit(float(card.cap)), F.greatest(F.lit(0.0), total)).cast("int")
    # The score is named once; level and reasons read the finished column.
    scored = scored.withColumn(card.score, score)
    texts = [F.when(F.col(f.name) > 0, f.text(F.col(f.name))) for f in card.factors if f.text is not None]
    scored = scored.withColumns(
        {
            card.level: risk_level(card.score, card.levels, card.lowest),
            card.reasons: F.array_join(F.array_compact(F.array(*texts)), card.separator),
        }
    )
    return scored if card.keep_points else scored.drop(*[f.name for f in card.factors])


def capped(count: str, each, cap) -> Column:
    return F.least(F.lit(cap), F.col(count) * F.lit(each))


def _pts(points: Column) -> Column:
    return F.concat(F.lit(" [+"), int_text(F.round(points.cast("double"), 0)), F.lit("pts]"))


def _negative_sentiment() -> Column:
    recent = F.col("recent_avg_sentiment")
    return F.when(recent < 0, F.least(F.lit(15.0), F.abs(recent) * 20)).otherwise(F.lit(0.0))


# Weights, caps, level thresholds and reason formats of the churn score.
LEVELS = (("Critical", 60), ("High", 30), ("Medium", 10))


def retention_card(levels: Sequence[tuple[str, int]] = LEVELS) -> Scorecard:
    """The eight-factor churn card."""
    lit, c = F.lit, F.col
    return Scorecard(
        levels=levels,
        factors=(
            Factor(
                "pts_late_payments",
                capped("late_payment_count", 5, 20),
                lambda p: F.concat(int_text(c("late_payment_count")), lit(" late payment(s)"), _pts(p)),
            ),
            Factor(
                "pts_rejected_claims",
                F.least(lit(Decimal("15.0")), c("rejected_claims") * lit(Decimal("7.5"))).cast("decimal(4,1)"),
                lambda p: F.concat(int_text(c("rejected_claims")), lit(" rejected claim(s)"), _pts(p)),
            ),
            Factor(
                "pts_outstanding_claims",
                capped("delayed_claims", 5, 10),
                lambda p: F.concat(int_text(c("delayed_claims")), lit(" claim(s) pending >30 days"), _pts(p)),
            ),
            Factor(
                "pts_negative_sentiment",
                _negative_sentiment(),
                lambda p: F.concat(
                    lit("Negative sentiment (avg "), number_text(c("recent_avg_sentiment"), 2), lit(")"), _pts(p)
                ),
            ),
            Factor(
                "pts_competitor",
                capped("competitor_mention_count", 5, 10),
                lambda p: F.concat(
                    int_text(c("competitor_mention_count")), lit(" competitor mention(s): "), c("competitors_named"), _pts(p)
                ),
            ),
            Factor(
                "pts_cancellation",
                F.when(c("cancellation_intent_count") > 0, 15).otherwise(0),
                lambda p: F.concat(lit("Cancellation intent expressed"), _pts(p)),
            ),
            Factor(
                "pts_renewal_risk",
                F.when(c("days_to_renewal").isNotNull() & (c("days_to_renewal") <= 30), 10).otherwise(0),
                lambda p: F.concat(lit("Renewal in "), int_text(c("days_to_renewal")), lit(" days"), _pts(p)),
            ),
            Factor(
                "pts_lapsed",
                F.when(c("lapsed_cancelled_policies") > 0, 5).otherwise(0),
                lambda p: F.concat(int_text(c("lapsed_cancelled_policies")), lit(" lapsed/cancelled policy(ies)"), _pts(p)),
            ),
        ),
    )


def score_customers(frame: DataFrame, levels: Sequence[tuple[str, int]] = LEVELS) -> DataFrame:
    """The 360 frame with points, churn score, risk level and reasons."""
    return apply_scorecard(frame, retention_card(levels))


# --- the earlier card: uncapped factors, two thresholds, comma-joined reasons ---------------------


def legacy_frame(
    customers: DataFrame,
    policies: DataFrame,
    claims: DataFrame,
    payments: DataFrame,
    interactions: DataFrame,
    as_of: dt.date | str,
) -> DataFrame:
    """Inputs of the earlier card, one row per customer."""
    today = as_date(as_of)
    pay = payments.groupBy("customer_id").agg(
        F.count_if(F.col("status") == "Overdue").alias("overdue_payments"),
        F.count_if(F.col("status") == "Failed").alias("failed_payments"),
    )
    days_open = days_between("claim_date", F.coalesce("resolution_date", today))
    claim = claims.groupBy("customer_id").agg(
        F.count_if(F.col("status") == "Rejected").alias("rejected_claims"),
        F.avg(days_open).alias("avg_claim_resolution_days"),
    )
    ix = interactions.groupBy("customer_id").agg(
        exact_avg(F.col("sentiment_score")).alias("avg_sentiment"),
        F.min("sentiment_score").alias("min_sentiment"),
        F.count_if(F.col("sentiment_score") < -0.3).alias("negative_interactions"),
    )
    pol = policies.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("policy_count"),
        F.sum("premium_amount").cast("decimal(18,2)").alias("total_premium"),
        F.min("end_date").alias("nearest_renewal"),
        F.count_if(F.col("status").isin("Lapsed", "Cancelled")).alias("inactive_policies"),
    )
    joined = customers.select("customer_id", "first_name", "last_name", "city", "segment")
    for side in (pol, pay, claim, ix):
        joined = joined.join(side, "customer_id", "left")
    return joined.select(
        "customer_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("name"),
        "city",
        "segment",
        "policy_count",
        "total_premium",
        "nearest_renewal",
        or_zero("overdue_payments").alias("overdue_payments"),
        or_zero("failed_payments").alias("failed_payments"),
        or_zero("rejected_claims").alias("rejected_claims"),
        or_zero("avg_claim_resolution_days").alias("avg_claim_resolution_days"),
        or_zero("avg_sentiment").alias("avg_sentiment"),
        "min_sentiment",
        or_zero("negative_interactions").alias("negative_interactions"),
        or_zero("inactive_policies").alias("inactive_policies"),
    )


def legacy_card(as_of: dt.date | str) -> Scorecard:
    lit, c = F.lit, F.col
    soon = F.date_add(as_date(as_of), 30)
    return Scorecard(
        # Weights, thresholds and reason formats of the earlier score.
        levels=(("Critical", 60), ("Medium", 30)),
        separator=", ",
        round_total=False,
        keep_points=False,
        factors=(
            Factor(
                "_overdue",
                c("overdue_payments") * 15,
                lambda p: F.concat(int_text(c("overdue_payments")), lit(" overdue payment(s)")),
            ),
            Factor("_failed", c("failed_payments") * 10, None),
            Factor(
                "_rejected",
                c("rejected_claims") * 20,
                lambda p: F.concat(int_text(c("rejected_claims")), lit(" rejected claim(s)")),
            ),
            Factor(
                "_slow",
                F.when(c("avg_claim_resolution_days") > 30, 15).otherwise(0),
                lambda p: F.concat(
                    lit("Slow claim resolution ("),
                    int_text(F.round(c("avg_claim_resolution_days"), 0)),
                    lit(" days avg)"),
                ),
            ),
            Factor(
                "_mood",
                F.when(c("avg_sentiment") < -0.2, 20).otherwise(0),
                lambda p: F.concat(lit("Negative sentiment (avg "), number_text(c("avg_sentiment"), 2), lit(")")),
            ),
            Factor(
                "_negative",
                c("negative_interactions") * 5,
                lambda p: F.concat(int_text(c("negative_interactions")), lit(" negative interaction(s)")),
            ),
            Factor(
                "_renewal",
                F.when(c("nearest_renewal") <= soon, 10).otherwise(0),
                lambda p: lit("Policy renewal within 30 days"),
            ),
            Factor(
                "_inactive",
                c("inactive_policies") * 10,
                lambda p: F.concat(int_text(c("inactive_policies")), lit(" lapsed/cancelled policy(ies)")),
            ),
        ),
    )


def legacy_score(frame: DataFrame, as_of: dt.date | str) -> DataFrame:
    return apply_scorecard(frame, legacy_card(as_of))


def fact_sheet(scored: DataFrame) -> DataFrame:
    """One line of text per customer with the facts a retention manager asks for first."""
    c, lit = F.col, F.lit
    text = F.concat(
        lit("Customer: "), c("name"),
        lit(" | City: "), c("city"),
        lit(" | Segment: "), c("segment"),
        lit(" | Policies: "), F.coalesce(c("policy_count").cast("string"), lit("0")),
        lit(" | Total Premium: INR "), F.coalesce(c("total_premium").cast("string"), lit("0")),
        lit(" | Churn Risk: "), c("churn_risk_score").cast("string"), lit("/100 ("), c("risk_level"), lit(")"),
        lit(" | Risk Factors: "), F.coalesce(c("risk_factors"), lit("None")),
        lit(" | Overdue Payments: "), c("overdue_payments").cast("string"),
        lit(" | Rejected Claims: "), c("rejected_claims").cast("string"),
        lit(" | Avg Sentiment: "), number_text(c("avg_sentiment"), 2),
    )
    return scored.select("customer_id", text.alias("fact_sheet"))
