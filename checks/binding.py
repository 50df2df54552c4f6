"""The driver's TPC-H-like tables seen as the retention data model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.text import Rule, TextRules
from holdfast.operators.decisions import record_decisions
from holdfast.operators.enrichment import enrich
from holdfast.operators.nba import as_recommendations, recommend
from holdfast.operators.scorecard import retention_card, score_customers
from holdfast.plans.daily import Facts
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import fresh_dir

AS_OF = dt.date(2001, 8, 1)
# Critical does not occur in the small tables with the standard thresholds.
LOW_LEVELS = (("Critical", 45), ("High", 30), ("Medium", 10))

# The documents are invented prose, so the word lists are invented too.
RULES = TextRules(
    positive=("that", "with", "than", "from"),
    negative=("this", "free", "license", "rewh", "orre", "thatin"),
    competitors=("hean", "hain"),
    cancel_words=("license",),
    intents=(Rule("complaint", score_below=0.0), Rule("claim_enquiry", any_of=("orre",))),
    signals=(Rule("cancellation_intent", any_of=("license",)), Rule("claim_delay", score_below=0.0)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.col("n_name").alias("last_name"),
            F.when(key % 50 != 0, (18 + key % 70).cast("int")).alias("age"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("c_mktsegment").alias("segment"),
            F.element_at(F.array(*map(F.lit, ("English", "Hindi", "Tamil"))), (key % 3 + 1).cast("int")).alias("preferred_language"),
        )
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    status = (
        F.when(F.col("o_orderstatus") == "O", "Active")
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "Lapsed")
        .otherwise("Expired")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("policy_id"),
        F.col("o_custkey").alias("customer_id"),
        F.lit("Motor").alias("product_type"),
        F.col("o_orderpriority").alias("vehicle_make"),
        F.col("o_orderstatus").alias("vehicle_model"),
        money(money("o_totalprice") * F.lit(Decimal("0.01"))).alias("premium_amount"),
        start.alias("start_date"),
        F.date_add(start, 365).alias("end_date"),
        status.alias("status"),
    )


def _lines(spark: SparkSession, sf_dir: str, first: bool, **columns: Column) -> DataFrame:
    """Lines with their customer, ``line_key``, quantity, date, amount and ``columns``.

    What a line says by itself is worked out before the join, so dates, whole numbers and cents are shuffled instead of the raw doubles.
    """
    line = F.col("l_linenumber")
    lines = (
        table(spark, sf_dir, "lineitem")
        .filter(line == 1 if first else line > 1)
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_shipdate").cast("date").alias("line_date"),
            money("l_extendedprice").alias("line_amount"),
            *[c.alias(name) for name, c in columns.items()],
        )
    )
    owner = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity")
    return lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("line_key", key)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    status = (
        F.when((flag == "R") & (qty >= 26), "Rejected")
        .when((flag == "N") & (F.col("l_linestatus") == "O") & (qty >= 40), "Pending")
        .when(flag == "A", "Settled")
        .otherwise("Approved")
    )
    amount, day, qty = F.col("line_amount"), F.col("line_date"), F.col("quantity")
    return _lines(spark, sf_dir, first=True, status=status).select(
        F.col("line_key").alias("claim_id"),
        F.col("l_orderkey").alias("policy_id"),
        "customer_id",
        day.alias("claim_date"),
        amount.alias("claim_amount"),
        F.when(F.col("status").isin("Settled", "Approved"), amount).alias("approved_amount"),
        "status",
        F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.when(F.col("status") != "Pending", F.date_add(day, qty)).alias("resolution_date"),
        F.when(F.col("status") == "Rejected", F.concat(F.lit("quantity "), qty.cast("string"))).alias("rejection_reason"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("l_tax") >= 0.07) & (F.col("l_discount") >= 0.08)
    fee = F.when(late, money(F.round(money("l_extendedprice") * F.lit(Decimal("0.05")), 2))).otherwise(F.lit(0).cast("decimal(12,2)"))
    due, amount = F.col("line_date"), F.col("line_amount")
    return (
        _lines(spark, sf_dir, first=False, late=late, late_fee=fee)
        .withColumn("status", F.when(F.col("late"), "Overdue").otherwise("Paid"))
        .select(
            F.col("line_key").alias("payment_id"),
            F.col("l_orderkey").alias("policy_id"),
            "customer_id",
            due.alias("due_date"),
            F.when(F.col("status") == "Paid", due).alias("paid_date"),
            amount.alias("amount"),
            "status",
            F.col("l_returnflag").alias("payment_method"),
            "late_fee",
        )
    )


def interactions_from(docs: DataFrame, customer: DataFrame) -> DataFrame:
    owners = customer.agg(F.floor(F.count(F.lit(1)) / 5).cast("bigint").alias("n")).scalar()
    return docs.select(
        F.col("doc_id").alias("interaction_id"),
        (F.col("doc_id") % owners).alias("customer_id"),
        F.col("lang").alias("channel"),
        F.col("source").alias("direction"),
        F.date_sub(F.lit(str(AS_OF)).cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp_ntz").alias("interaction_ts"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("double").alias("sentiment_score"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "customer"))


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and data set below the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = fresh_dir(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


class Data:
    """The retention tables of one data set; stored where the reference stores them, lazy elsewhere."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    @property
    def policies(self) -> DataFrame:
        return policies(self.spark, self.sf_dir)

    @property
    def claims(self) -> DataFrame:
        return claims(self.spark, self.sf_dir)

    @property
    def payments(self) -> DataFrame:
        return payments(self.spark, self.sf_dir)

    @property
    def interactions(self) -> DataFrame:
        return interactions(self.spark, self.sf_dir)

    @property
    def insights(self) -> DataFrame:
        return stored(self.spark, self.sf_dir, "insights", lambda: enrich(self.interactions, RULES, partitions=self.spark.sparkContext.defaultParallelism))

    @property
    def facts(self) -> Facts:
        return Facts(self.customers, self.policies, self.claims, self.payments, self.insights)

    @property
    def frame(self) -> DataFrame:
        """The 360 view, recomputed on read."""
        return self.facts.frame(AS_OF)

    @property
    def scored(self) -> DataFrame:
        return score_customers(self.frame)

    @property
    def snapshot(self) -> DataFrame:
        """The scored 360 frame as the dashboard tiles share it: stored once."""
        return stored(self.spark, self.sf_dir, "scored_360", lambda: self.scored)

    def snapshot_at(self, levels) -> DataFrame:
        names = ["churn_risk_score", "risk_level", "risk_factors", *[f.name for f in retention_card().factors]]
        return score_customers(self.snapshot.drop(*names), levels)

    @property
    def recommendations(self) -> DataFrame:
        return stored(
            self.spark,
            self.sf_dir,
            "recommendations",
            lambda: as_recommendations(recommend(self.snapshot, self.claims, self.insights, AS_OF)),
        )

    @property
    def decisions(self) -> DataFrame:
        """First approvals of confident or discounted recommendations, then edits of discounts and rejections of doubtful ones."""
        rec, c, lit = self.recommendations, F.col, F.lit
        at = "timestamp_ntz"
        first = rec.filter((c("confidence_score") >= 0.85) | c("discount_amount").isNotNull()).select(
            "recommendation_id",
            lit("Approve").alias("decision"),
            lit("ignored text").alias("edited_action"),
            lit("").alias("manager_notes"),
            F.concat(lit("desk "), c("action_code")).alias("decided_by"),
            lit("2001-08-01 09:00:00").cast(at).alias("decided_at"),
        )
        discounted = c("discount_amount").isNotNull()
        doubtful = c("compliance_status") == "NEEDS_HUMAN_REVIEW"
        second = rec.filter(discounted | doubtful).select(
            "recommendation_id",
            F.when(discounted, "Edit").otherwise("Reject").alias("decision"),
            F.when(discounted, F.concat(lit("Loyalty credit instead of: "), c("recommended_action"))).alias("edited_action"),
            F.when(~discounted, "Not appropriate").alias("manager_notes"),
            lit("lead").alias("decided_by"),
            lit("2001-08-01 17:30:00").cast(at).alias("decided_at"),
        )
        return first.unionByName(second)

    @property
    def log(self) -> DataFrame:
        return stored(
            self.spark, self.sf_dir, "action_log", lambda: record_decisions(self.recommendations, self.decisions)
        )

    def tables(self, label: str) -> Tables:
        """An empty set of tables in a fresh folder."""
        return Tables(self.spark, fresh_dir(self.spark, label))
