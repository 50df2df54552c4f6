"""Data-quality checks. Every check is one row: check, expected, actual, passed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import is_blank
from holdfast.functions.text import sentiment_label
from holdfast.operators.ids import dense_numbers
from holdfast.operators.nba import DISCOUNT_CAP, DISCOUNT_RATE, complaints, customer_rules
from holdfast.operators.scorecard import retention_card
from holdfast.schemas import CHURN_SIGNALS, INTENTS, SENTIMENT_LABELS


def counted(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One pass over ``df``; each check counts the rows that break a rule and expects 0."""
    names = list(checks)
    one_row = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(checks.values())])
    rows = F.array(
        *[F.struct(F.lit(n).alias("check"), F.lit(0).cast("bigint").alias("expected"), F.col(f"c{i}").alias("actual")) for i, n in enumerate(names)]
    )
    return judged(one_row.select(F.inline(rows)))


def judged(df: DataFrame) -> DataFrame:
    return df.select("check", "expected", "actual", F.equal_null("expected", "actual").alias("passed"))


def compare(check: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two one-row, one-column aggregates that should agree."""
    row = expected.select(F.lit(check).alias("check"), expected.scalar().cast("bigint").alias("expected"), actual.scalar().cast("bigint").alias("actual"))
    return judged(row)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unique_key(df: DataFrame, key: str, label: str) -> DataFrame:
    return counted(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), {f"unique {label}": F.col("n") > 1})


def orphan_counts(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """(key, rows) of foreign keys without a parent.

    Child rows are counted per key before the anti-join, so a hot key is one row in it.
    """
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    parents = parent.select(F.col(parent_key or key).alias(key))
    return per_key.join(parents, key, "left_anti")


def foreign_key(child: DataFrame, key: str, parent: DataFrame, label: str) -> DataFrame:
    orphans = orphan_counts(child, key, parent)
    total = orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("actual"))
    return judged(total.select(F.lit(f"orphans {label}").alias("check"), F.lit(0).cast("bigint").alias("expected"), "actual"))


def key_checks(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    return union_all([unique_key(df, key, name) for name, (df, key) in tables.items()])


def union_all(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def presence_checks(customers: DataFrame, policies: DataFrame, interactions: DataFrame, insights: DataFrame, recommendations: DataFrame) -> DataFrame:
    return union_all(
        [
            counted(customers, {"customer names present": is_blank("first_name") | is_blank("last_name")}),
            counted(policies, {"premium present": F.col("premium_amount").isNull()}),
            counted(interactions, {"content present": is_blank("content")}),
            counted(insights, {"sentiment present": F.col("sentiment_score").isNull()}),
            counted(recommendations, {"action code present": F.col("action_code").isNull()}),
        ]
    )


def score_checks(scored: DataFrame, customers: DataFrame) -> DataFrame:
    points = [f.name for f in retention_card().factors]
    total = reduce(lambda a, b: a + b, [F.col(p).cast("double") for p in points], F.lit(0.0))
    score = F.col("churn_risk_score")
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(total, 0)))
    rows = F.count(F.lit(1)).alias("n")
    return union_all(
        [
            counted(
                scored,
                {
                    "score within 0..100": score.isNull() | ~score.between(0, 100),
                    "score equals sum of points": ~F.equal_null(score.cast("double"), bounded),
                },
            ),
            unique_key(scored, "customer_id", "customer in 360"),
            compare("all customers in 360", customers.agg(rows), scored.agg(rows)),
        ]
    )


def claimless_customers(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("total_claims") == 0).alias("customers_without_claims"))


def premium_check(scored: DataFrame, policies: DataFrame) -> DataFrame:
    """The portfolio premium in the 360 frame equals the sum over active policies (in cents)."""
    cents = lambda c: (F.coalesce(F.sum(c), F.lit(0)) * 100).cast("bigint").alias("cents")
    active = policies.filter(F.col("status") == "Active")
    return compare("premium not inflated", active.agg(cents("premium_amount")), scored.agg(cents("total_active_premium")))


def insight_checks(insights: DataFrame, interactions: DataFrame) -> DataFrame:
    score = F.col("sentiment_score")
    filled = interactions.filter(~is_blank("content"))
    rows = F.count(F.lit(1)).alias("n")
    return union_all(
        [
            counted(
                insights,
                {
                    "sentiment within -1..1": score.isNull() | ~score.between(-1, 1),
                    "label matches score": F.col("sentiment_label") != sentiment_label("sentiment_score"),
                    "label known": ~F.col("sentiment_label").isin(*SENTIMENT_LABELS),
                    "intent known": ~F.col("primary_intent").isin(*INTENTS),
                    "signal known": ~F.col("churn_signal").isin(*CHURN_SIGNALS),
                },
            ),
            compare("every transcript enriched", filled.agg(rows), insights.agg(rows)),
        ]
    )


def claim_reference_checks(recommendations: DataFrame, claims: DataFrame, insights: DataFrame) -> DataFrame:
    """Escalations need a pending claim; reviews need a rejected claim and a complaint."""
    c, none = F.col, F.lit(False)
    status = c("status")
    claimed = (
        claims.filter(status.isin("Pending", "Rejected"))
        .groupBy("customer_id")
        .agg(F.max(status == "Pending").alias("_pending"), F.max(status == "Rejected").alias("_rejected"))
    )
    complained = complaints(insights).select("customer_id").distinct().withColumn("_complained", F.lit(True))
    # Every evidence has one row a customer, so each recommendation meets all of it once and is counted once.
    chosen = recommendations.filter(c("action_code").isin("CLAIM_ESCALATION", "CLAIM_REVIEW")).select("customer_id", "action_code")
    seen = chosen.join(claimed, "customer_id", "left").join(complained, "customer_id", "left")
    escalation, review = (c("action_code") == code for code in ("CLAIM_ESCALATION", "CLAIM_REVIEW"))
    return counted(
        seen,
        {
            "escalation has pending claim": escalation & ~F.coalesce("_pending", none),
            "review has rejected claim": review & ~F.coalesce("_rejected", none),
            "review has complaint": review & ~F.coalesce("_complained", none),
        },
    )


def recommendation_checks(recommendations: DataFrame) -> DataFrame:
    c = F.col
    over = (c("discount_amount") > DISCOUNT_CAP) | (c("discount_amount") > F.round(c("premium_at_risk") * F.lit(DISCOUNT_RATE), 0))
    unreviewed = (c("confidence_score") < 0.60) & (c("compliance_status") != "NEEDS_HUMAN_REVIEW")
    codes = recommendations.groupBy("customer_id").agg(
        F.count_if(c("action_code") == "RETENTION_DISCOUNT").alias("d"),
        F.count_if(c("action_code") == "RENEWAL_INCENTIVE").alias("i"),
    )
    return union_all(
        [
            counted(
                recommendations,
                {
                    "discount within cap": over,
                    "low confidence reviewed": unreviewed,
                    "rationale present": is_blank("rationale"),
                },
            ),
            unique_key(recommendations, "customer_id", "recommendation per customer"),
            counted(codes, {"no discount with incentive": (c("d") > 0) & (c("i") > 0)}),
        ]
    )


SENSITIVE = ("age", "gender", "preferred_language")


def with_others_attributes(scored: DataFrame, names: Sequence[str] = SENSITIVE) -> DataFrame:
    """Every customer with the sensitive attributes of the next one in the order of ids."""
    numbered = dense_numbers(scored.select("customer_id", *names), ["customer_id"], "_place")
    last = numbered.agg(F.max("_place")).scalar()
    giver = numbered.select(F.when(F.col("_place") == 1, last).otherwise(F.col("_place") - 1).alias("_place"), *names)
    given = numbered.select("customer_id", "_place").join(giver, "_place").drop("_place")
    return scored.drop(*names).join(given, "customer_id").select(*scored.columns)


def eligibility(scored: DataFrame) -> DataFrame:
    """(customer_id, action_code) of the customer rules."""
    codes = F.array_compact(F.array(*[F.when(r.applies, F.lit(r.code)) for r in customer_rules()]))
    return scored.select("customer_id", F.explode(codes).alias("action_code"))


def fairness_check(scored: DataFrame, decide: Callable[[DataFrame], DataFrame] = eligibility) -> DataFrame:
    """Decisions (customer_id and more columns) must be the same when customers swap their sensitive attributes."""
    as_is, swapped = decide(scored), decide(with_others_attributes(scored))
    both = as_is.withColumn("_n", F.lit(1)).unionByName(swapped.withColumn("_n", F.lit(-1)))
    changed = both.groupBy(*as_is.columns).agg(F.sum("_n").alias("_n"))
    return counted(changed, {"decisions changed by sensitive attributes": F.col("_n") != 0})


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows") for name, df in tables.items()])
