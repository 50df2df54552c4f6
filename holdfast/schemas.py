"""Table schemas, load defaults and value sets of the retention data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# Enumerations of the data model.
POLICY_STATUS = ("Active", "Lapsed", "Cancelled", "Expired")
CLAIM_STATUS = ("Settled", "Approved", "Rejected", "Pending")
PAYMENT_STATUS = ("Paid", "Overdue", "Failed", "Pending")
INTENTS = ("claim_enquiry", "complaint", "renewal", "payment", "cancellation", "feedback", "general")
CHURN_SIGNALS = (
    "claim_delay",
    "price_shock",
    "missed_payment",
    "competitor_mention",
    "cancellation_intent",
    "none",
)
SENTIMENT_LABELS = ("positive", "negative", "neutral")
RISK_LEVELS = ("Critical", "High", "Medium", "Low")
COMPLIANCE = ("PENDING", "COMPLIANT", "FLAGGED", "NEEDS_HUMAN_REVIEW")
DECISIONS = ("APPROVE", "EDIT", "REJECT")
RUN_STATUS = ("RUNNING", "COMPLETED", "PARTIAL_FAIL")


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()
_REQUIRED, _OPTIONAL = False, True

CUSTOMERS = _schema(
    ("customer_id", _S, _REQUIRED),
    ("first_name", _S, _REQUIRED),
    ("last_name", _S, _REQUIRED),
    ("age", _I, _OPTIONAL),
    ("gender", _S, _OPTIONAL),
    ("city", _S, _OPTIONAL),
    ("state", _S, _OPTIONAL),
    ("pin_code", _S, _OPTIONAL),
    ("phone", _S, _OPTIONAL),
    ("email", _S, _OPTIONAL),
    ("segment", _S, _OPTIONAL),
    ("preferred_language", _S, _OPTIONAL),
    ("created_at", _TS, _OPTIONAL),
)

POLICIES = _schema(
    ("policy_id", _S, _REQUIRED),
    ("customer_id", _S, _REQUIRED),
    ("product_type", _S, _REQUIRED),
    ("vehicle_type", _S, _OPTIONAL),
    ("vehicle_make", _S, _OPTIONAL),
    ("vehicle_model", _S, _OPTIONAL),
    ("vehicle_year", _I, _OPTIONAL),
    ("plan_name", _S, _OPTIONAL),
    ("sum_insured", MONEY, _OPTIONAL),
    ("premium_amount", MONEY, _REQUIRED),
    ("payment_frequency", _S, _OPTIONAL),
    ("start_date", _D, _REQUIRED),
    ("end_date", _D, _REQUIRED),
    ("renewal_date", _D, _OPTIONAL),
    ("status", _S, _OPTIONAL),
    ("ncb_percentage", _I, _OPTIONAL),
    ("auto_renew", T.BooleanType(), _OPTIONAL),
    ("created_at", _TS, _OPTIONAL),
)

CLAIMS = _schema(
    ("claim_id", _S, _REQUIRED),
    ("policy_id", _S, _REQUIRED),
    ("customer_id", _S, _REQUIRED),
    ("claim_date", _D, _REQUIRED),
    ("claim_amount", MONEY, _REQUIRED),
    ("approved_amount", MONEY, _OPTIONAL),
    ("status", _S, _OPTIONAL),
    ("category", _S, _OPTIONAL),
    ("resolution_date", _D, _OPTIONAL),
    ("rejection_reason", _S, _OPTIONAL),
    ("notes", _S, _OPTIONAL),
    ("created_at", _TS, _OPTIONAL),
)

PAYMENTS = _schema(
    ("payment_id", _S, _REQUIRED),
    ("policy_id", _S, _REQUIRED),
    ("customer_id", _S, _REQUIRED),
    ("due_date", _D, _REQUIRED),
    ("paid_date", _D, _OPTIONAL),
    ("amount", MONEY, _REQUIRED),
    ("status", _S, _OPTIONAL),
    ("payment_method", _S, _OPTIONAL),
    ("late_fee", MONEY, _OPTIONAL),
    ("created_at", _TS, _OPTIONAL),
)

INTERACTIONS = _schema(
    ("interaction_id", _S, _REQUIRED),
    ("customer_id", _S, _REQUIRED),
    ("channel", _S, _REQUIRED),
    ("direction", _S, _REQUIRED),
    ("interaction_ts", _TS, _REQUIRED),
    ("subject", _S, _OPTIONAL),
    ("content", _S, _REQUIRED),
    ("summary", _S, _OPTIONAL),
    ("sentiment_score", T.DoubleType(), _OPTIONAL),
    ("created_at", _TS, _OPTIONAL),
)

ACTION_CATALOG = _schema(
    ("action_code", _S, _REQUIRED),
    ("action_name", _S, _REQUIRED),
    ("description", _S, _OPTIONAL),
    ("priority", _I, _REQUIRED),
    ("max_discount_pct", T.DoubleType(), _OPTIONAL),
    ("max_discount_amt", MONEY, _OPTIONAL),
    ("compliance_notes", _S, _OPTIONAL),
)

RUN_LOG = _schema(
    ("run_id", _S, _REQUIRED),
    ("run_start", _TS, _REQUIRED),
    ("run_end", _TS, _OPTIONAL),
    ("status", _S, _REQUIRED),
    ("new_interactions", T.LongType(), _OPTIONAL),
    ("enriched_count", T.LongType(), _OPTIONAL),
    ("nba_generated", T.LongType(), _OPTIONAL),
    ("error_message", _S, _OPTIONAL),
    ("details", _S, _OPTIONAL),
)

RAW_TABLES = {
    "customers": CUSTOMERS,
    "policies": POLICIES,
    "claims": CLAIMS,
    "payments": PAYMENTS,
    "interactions": INTERACTIONS,
}

# A default fills a column only when the load list leaves it out.
# ``created_at`` is given by the caller of the load.
LOAD_DEFAULTS = {
    "customers": {"preferred_language": "English"},
    "policies": {
        "payment_frequency": "Annual",
        "status": "Active",
        "ncb_percentage": 0,
        "auto_renew": True,
    },
    "claims": {"status": "Pending"},
    "payments": {"status": "Pending", "late_fee": 0},
    "interactions": {},
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "policies": "policy_id",
    "claims": "claim_id",
    "payments": "payment_id",
    "interactions": "interaction_id",
}

# child table -> [(foreign key, parent table)]
FOREIGN_KEYS = {
    "policies": [("customer_id", "customers")],
    "claims": [("policy_id", "policies"), ("customer_id", "customers")],
    "payments": [("policy_id", "policies"), ("customer_id", "customers")],
    "interactions": [("customer_id", "customers")],
}

# Parents come before their children.
LOAD_ORDER = ("customers", "policies", "claims", "payments", "interactions")
