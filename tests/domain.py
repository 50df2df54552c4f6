"""Hand-made rows of the retention model; unnamed columns get a plain value."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.plans.daily import Facts

AS_OF = dt.date(2025, 9, 28)

INSIGHTS = T.StructType(
    [
        T.StructField(n, k)
        for n, k in (
            ("interaction_id", T.StringType()),
            ("customer_id", T.StringType()),
            ("channel", T.StringType()),
            ("direction", T.StringType()),
            ("interaction_ts", T.TimestampNTZType()),
            ("sentiment_score", T.DoubleType()),
            ("sentiment_label", T.StringType()),
            ("primary_intent", T.StringType()),
            ("churn_signal", T.StringType()),
            ("competitor", T.StringType()),
            ("summary", T.StringType()),
            ("key_quote", T.StringType()),
        )
    ]
)

_PLAIN = {
    "customers": {"first_name": "Asha", "last_name": "Rao", "city": "Pune", "state": "MH", "segment": "Individual"},
    "policies": {
        "product_type": "Car",
        "premium_amount": Decimal("1000.00"),
        "start_date": dt.date(2025, 1, 1),
        "end_date": dt.date(2026, 1, 1),
        "status": "Active",
    },
    "claims": {"policy_id": "P", "claim_date": AS_OF, "claim_amount": Decimal("500.00"), "status": "Settled", "category": "Theft"},
    "payments": {"policy_id": "P", "due_date": AS_OF, "amount": Decimal("100.00"), "status": "Paid", "late_fee": Decimal("0.00")},
    "interactions": {"customer_id": "C1", "channel": "Call", "direction": "Inbound", "interaction_ts": dt.datetime(2025, 9, 1), "content": "Hello."},
    "insights": {
        "channel": "Call",
        "direction": "Inbound",
        "interaction_ts": dt.datetime(2025, 9, 1),
        "sentiment_score": 0.0,
        "sentiment_label": "neutral",
        "primary_intent": "general",
        "churn_signal": "none",
    },
}
_SCHEMAS = schemas.RAW_TABLES | {"insights": INSIGHTS}
_IDS = schemas.PRIMARY_KEYS | {"insights": "interaction_id"}


def rows(spark: SparkSession, table: str, *given: dict) -> DataFrame:
    schema, key = _SCHEMAS[table], _IDS[table]
    made = []
    for i, row in enumerate(given):
        full = _PLAIN[table] | {key: f"{table}-{i:05d}"} | row
        made.append(tuple(full.get(f.name) for f in schema.fields))
    return spark.createDataFrame(made, schema)


def facts(spark: SparkSession, customers=("C1",), policies=(), claims=(), payments=(), insights=()) -> Facts:
    people = [c if isinstance(c, dict) else {"customer_id": c} for c in customers]
    return Facts(
        rows(spark, "customers", *people),
        rows(spark, "policies", *policies),
        rows(spark, "claims", *claims),
        rows(spark, "payments", *payments),
        rows(spark, "insights", *insights),
    )


def days_ago(n: int) -> dt.date:
    return AS_OF - dt.timedelta(days=n)
