"""Manager decisions on recommendations: recording, history, what is still pending."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import exact_avg, is_blank, stable_id
from holdfast.operators.pick import best_fields
from holdfast.operators.skew import join_to_unique

LOG_COLUMNS = (
    "log_id", "recommendation_id", "customer_id", "action_code", "decision", "original_action", "final_action", "manager_notes",
    "decided_by", "decided_at",
)


def record_decisions(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Action-log rows for a batch of decisions (recommendation_id, decision, edited_action, manager_notes,
    decided_by, decided_at).

    Only an EDIT changes the action text. The log id derives from the decision, so a
    replayed batch gives the same rows.
    """
    decision = F.upper("decision")
    edited = (decision == "EDIT") & ~is_blank("edited_action")
    decided = recommendations.select("recommendation_id", "customer_id", "action_code", "recommended_action")
    joined = join_to_unique(decisions, decided, "recommendation_id", ["decided_at", "decided_by", "decision"], "inner")
    return joined.select(
        stable_id("LOG", "recommendation_id", decision, "decided_by", "decided_at").alias("log_id"),
        "recommendation_id",
        "customer_id",
        "action_code",
        decision.alias("decision"),
        F.col("recommended_action").alias("original_action"),
        F.when(edited, F.col("edited_action")).otherwise(F.col("recommended_action")).alias("final_action"),
        F.when(~is_blank("manager_notes"), F.col("manager_notes")).alias("manager_notes"),
        "decided_by",
        "decided_at",
    )


def one_decision(spark, recommendation_id: str, decision: str, decided_by: str, decided_at: dt.datetime, edited_action=None, manager_notes=None) -> DataFrame:
    """A single decision as a batch of one row."""
    schema = "recommendation_id string, decision string, edited_action string, manager_notes string, decided_by string, decided_at timestamp_ntz"
    return spark.createDataFrame([(recommendation_id, decision, edited_action, manager_notes, decided_by, decided_at)], schema)


def pending(recommendations: DataFrame, log: DataFrame) -> DataFrame:
    """Recommendations without any decision."""
    decided = log.select("recommendation_id").distinct()  # shrinks many decisions of one id on the map side
    return recommendations.join(decided, "recommendation_id", "left_anti")


def pending_with_names(recommendations: DataFrame, log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pending recommendations with the action name; the catalogue has a handful of rows by definition."""
    return pending(recommendations, log).join(F.broadcast(catalog.select("action_code", "action_name")), "action_code")


def pending_summary(recommendations: DataFrame, log: DataFrame) -> DataFrame:
    """Per action code: how many wait, their premium and mean confidence."""
    return (
        pending(recommendations, log)
        .groupBy("action_code")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("premium_at_risk").cast("decimal(18,2)").alias("premium_at_risk"),
            F.round(exact_avg(F.col("confidence_score").cast("double")), 2).alias("avg_confidence"),
        )
        .orderBy(F.col("count").desc(), "action_code")
    )


def latest_decisions(log: DataFrame) -> DataFrame:
    """The latest decision of every customer."""
    return best_fields(
        log, ["customer_id"], ["decided_at", "log_id"], ["recommendation_id", "decision", "final_action", "decided_by", "decided_at"], latest=True
    )


def recent_decisions(log: DataFrame, n: int = 20) -> DataFrame:
    return (
        log.orderBy(F.col("decided_at").desc(), "log_id")
        .limit(n)
        .select("log_id", "customer_id", "action_code", "decision", F.left("final_action", F.lit(100)).alias("action"), "decided_by", "decided_at")
    )
