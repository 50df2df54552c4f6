"""Next-best-action engine: rules, evidence, one action per customer, confidence, compliance."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.columns import as_date, count_flags, days_between, int_text, map_value, money_text, number_text
from holdfast.operators.ids import highest_number, with_ids
from holdfast.operators.pick import best_fields
from holdfast.operators.skew import join_to_unique
from holdfast.sources.workspace import written_keys
from holdfast.schemas import ACTION_CATALOG

# The action catalogue.
ACTIONS = (
    ("CLAIM_ESCALATION", "Escalate Pending Claim", "Escalate claims stuck in Pending >30 days to senior claims officer.", 1, None, None, "Must reference real CLAIM_ID in Pending status."),
    ("CLAIM_REVIEW", "Re-review Rejected Claim", "Re-review rejected claim where customer has complained.", 2, None, None, "Must reference real CLAIM_ID and rejection reason."),
    ("RETENTION_DISCOUNT", "Offer Retention Discount", "Premium discount for high-risk customer with competitor/cancellation signals.", 3, 0.15, Decimal("10000.00"), "Max 15% or Rs.10000. No age/gender/language bias. Cannot combine with RENEWAL_INCENTIVE."),
    ("PAYMENT_PLAN", "Offer Flexible Payment Plan", "Switch to quarterly/monthly for customers with overdue payments.", 4, None, None, "Cannot waive late fees without manager approval."),
    ("RENEWAL_INCENTIVE", "Early Renewal Incentive", "NCB bonus uplift for early renewal.", 5, 0.10, None, "Max 10% NCB uplift. No cancellation intent required."),
    ("PROACTIVE_CALLBACK", "Schedule Proactive Callback", "Retention callback for at-risk customers with negative interactions.", 6, None, None, "Not for Low-risk. Catch-all when no specific action fits."),
)
PRIORITY = {row[0]: row[3] for row in ACTIONS}
CLAIM_ACTIONS = ("CLAIM_ESCALATION", "CLAIM_REVIEW")

# Thresholds, discount rule, confidence weights.
ESCALATE_AFTER_DAYS = 30
DISCOUNT_RATE = Decimal("0.15")
DISCOUNT_CAP = 10000
REVIEW_BELOW = Decimal("0.60")
BASE_CONFIDENCE = {
    "CLAIM_ESCALATION": "0.80",
    "CLAIM_REVIEW": "0.75",
    "RETENTION_DISCOUNT": "0.70",
    "PAYMENT_PLAN": "0.70",
    "RENEWAL_INCENTIVE": "0.60",
    "PROACTIVE_CALLBACK": "0.55",
}
COMPLAINT_INTENTS = ("claim_enquiry", "complaint")
COMPLAINT_SIGNALS = ("claim_delay", "cancellation_intent")
AT_RISK = ("Critical", "High")
WATCHED = ("Critical", "High", "Medium")

_RECOMMENDATION = "struct<action_code:string,priority:int,recommended_action:string,discount_amount:decimal(12,2),supporting_evidence:string>"


def action_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACTIONS), ACTION_CATALOG)


# --- evidence --------------------------------------------------------------------------------------


def complaints(insights: DataFrame) -> DataFrame:
    return insights.filter(
        F.col("primary_intent").isin(*COMPLAINT_INTENTS) & F.col("churn_signal").isin(*COMPLAINT_SIGNALS)
    )


def latest_complaint(insights: DataFrame) -> DataFrame:
    """Per customer the id and quote of the latest complaint-like interaction."""
    picked = best_fields(
        complaints(insights),
        ["customer_id"],
        ["interaction_ts", "interaction_id"],
        ["interaction_id", "key_quote"],
        latest=True,
    )
    return picked.withColumnsRenamed({"interaction_id": "complaint_ix_id", "key_quote": "complaint_quote"})


def _claims_with_age(claims: DataFrame, as_of: dt.date | str) -> DataFrame:
    return claims.select(
        "customer_id",
        "claim_id",
        "claim_amount",
        F.col("status").alias("claim_status"),
        "claim_date",
        "rejection_reason",
        "category",
        days_between("claim_date", as_date(as_of)).alias("days_since_claim"),
    )


def claim_evidence(claims: DataFrame, insights: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Every claim with its age and the customer's latest complaint.

    The complaint side holds one row per customer, so the join never fans out.
    """
    return join_to_unique(_claims_with_age(claims, as_of), latest_complaint(insights), "customer_id", ["claim_id"])


def oldest_actionable_claims(claims: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Per customer the oldest overdue pending claim and the oldest rejected claim.

    The rules need at most these two rows, so claims shrink to one row per customer in
    the map-side aggregate before anything is joined.
    """
    age = days_between("claim_date", as_date(as_of))
    packed = F.struct("claim_date", "claim_id", "category", "claim_amount", "rejection_reason")
    pending = (F.col("status") == "Pending") & (age > ESCALATE_AFTER_DAYS)
    rejected = F.col("status") == "Rejected"
    return (
        claims.filter(pending | rejected)
        .groupBy("customer_id")
        .agg(F.min(F.when(pending, packed)).alias("pending_claim"), F.min(F.when(rejected, packed)).alias("rejected_claim"))
    )


# --- texts -----------------------------------------------------------------------------------------


def _escalation_texts(claim_id, category, amount, days, quote) -> tuple[Column, Column]:
    lit = F.lit
    action = F.concat(
        lit("Escalate claim "), claim_id, lit(" ("), category, lit(", Rs. "), money_text(amount), lit(") pending "), int_text(days), lit(" days"),
    )
    evidence = F.concat(
        lit("Claim "), claim_id, lit(": "), category, lit(", Rs. "), money_text(amount), lit(", pending "), int_text(days), lit(" days."),
        F.coalesce(F.concat(lit(' Customer: "'), quote, lit('"')), lit("")),
    )
    return action, evidence


def _review_texts(claim_id, category, amount, reason, complaint_id, quote) -> tuple[Column, Column]:
    lit = F.lit
    action = F.concat(
        lit("Re-review claim "), claim_id, lit(" ("), category, lit(", Rs. "), money_text(amount), lit("). Rejection: "),
        F.coalesce(reason, lit("unspecified")),
    )
    evidence = F.concat(
        lit("Claim "), claim_id, lit(" rejected: "), F.coalesce(reason, lit("N/A")),
        lit(". Complaint interaction "), complaint_id.cast("string"), lit("."),
        F.coalesce(F.concat(lit(' Quote: "'), quote, lit('"')), lit("")),
    )
    return action, evidence


def discount_amount(premium: str | Column = "total_active_premium") -> Column:
    """15 % of the active premium in whole rupees, at most 10,000."""
    premium = F.col(premium) if isinstance(premium, str) else premium
    share = F.round(premium.cast("decimal(18,2)") * F.lit(DISCOUNT_RATE), 0)
    return F.least(share, F.lit(DISCOUNT_CAP)).cast("decimal(12,2)")


@dataclass(frozen=True)
class Rule:
    code: str
    applies: Column
    action: Column
    evidence: Column
    discount: Column | None = None

    def offer(self) -> Column:
        discount = F.lit(None) if self.discount is None else self.discount
        return F.struct(
            F.lit(self.code).alias("action_code"),
            F.lit(PRIORITY[self.code]).alias("priority"),
            self.action.alias("recommended_action"),
            discount.cast("decimal(12,2)").alias("discount_amount"),
            self.evidence.alias("supporting_evidence"),
        ).cast(_RECOMMENDATION)


def customer_rules() -> list[Rule]:
    """The four rules that read nothing but the 360 row."""
    c, lit = F.col, F.lit
    watched = c("risk_level").isin(*WATCHED)
    discount = discount_amount()
    mentions = F.when(
        c("competitor_mention_count") > 0, F.concat(int_text(c("competitor_mention_count")), lit(" competitor mention(s). "))
    ).otherwise("")
    cancels = F.when(
        c("cancellation_intent_count") > 0, F.concat(int_text(c("cancellation_intent_count")), lit(" cancellation intent(s). "))
    ).otherwise("")
    return [
        Rule(
            "RETENTION_DISCOUNT",
            c("risk_level").isin(*AT_RISK)
            & (c("total_active_premium") > 0)
            & ((c("competitor_mention_count") > 0) | (c("cancellation_intent_count") > 0)),
            F.concat(lit("Offer Rs. "), int_text(discount), lit(" retention discount")),
            F.concat(lit("Risk: "), c("risk_level"), lit(". "), mentions, cancels, lit("Premium: Rs. "), money_text(c("total_active_premium"))),
            discount,
        ),
        Rule(
            "PAYMENT_PLAN",
            (c("late_payment_count") >= 2) & (c("active_policies") > 0),
            F.concat(
                lit("Offer quarterly payments ("), int_text(c("late_payment_count")), lit(" overdue, Rs. "),
                money_text(c("total_late_fees")), lit(" late fees)"),
            ),
            F.concat(
                int_text(c("late_payment_count")), lit(" overdue payments. Late fees: Rs. "), money_text(c("total_late_fees")),
                lit(". Active policies: "), int_text(c("active_policies")),
            ),
        ),
        Rule(
            "RENEWAL_INCENTIVE",
            watched & (c("cancellation_intent_count") == 0) & (c("active_policies") > 0),
            F.concat(lit("Offer 10% NCB uplift (premium Rs. "), money_text(c("total_active_premium")), lit(")")),
            F.concat(
                lit("Risk: "), c("risk_level"), lit(". No cancellation intent. Active policies: "), int_text(c("active_policies"))
            ),
        ),
        Rule(
            "PROACTIVE_CALLBACK",
            watched & (c("negative_interaction_count") >= 1),
            F.concat(
                lit("Schedule callback (risk "), int_text(c("churn_risk_score")), lit("/100, "),
                int_text(c("negative_interaction_count")), lit(" negative)"),
            ),
            F.concat(
                lit("Risk: "), c("risk_level"), lit(". Negative interactions: "), int_text(c("negative_interaction_count")),
                lit(". Sentiment: "), number_text(c("avg_sentiment"), 2),
            ),
        ),
    ]


def _offers(frame: DataFrame, offer: Column) -> DataFrame:
    return frame.select(
        "customer_id",
        F.col("churn_risk_score").alias("risk_score"),
        F.col("total_active_premium").cast("decimal(18,2)").alias("premium_at_risk"),
        offer.alias("_offer"),
    ).select("customer_id", "_offer.*", "risk_score", "premium_at_risk")


def rule_offers(scored: DataFrame, code: str) -> DataFrame:
    """All customers that qualify for one of the customer rules."""
    rule = next(r for r in customer_rules() if r.code == code)
    return _offers(scored.filter(rule.applies), rule.offer())


def claim_offers(scored: DataFrame, claims: DataFrame, insights: DataFrame, as_of: dt.date | str, code: str) -> DataFrame:
    """One offer per qualifying claim for CLAIM_ESCALATION or CLAIM_REVIEW."""
    c = F.col
    customers = scored.select("customer_id", "churn_risk_score", "total_active_premium").join(
        latest_complaint(insights), "customer_id", "left"
    )
    rows = _claims_with_age(claims, as_of)
    # The status filter reaches the claim scan; only qualifying claims meet the customers.
    if code == "CLAIM_ESCALATION":
        rows = rows.filter((c("claim_status") == "Pending") & (c("days_since_claim") > ESCALATE_AFTER_DAYS))
        texts = _escalation_texts(
            c("claim_id"), c("category"), c("claim_amount"), c("days_since_claim"), c("complaint_quote")
        )
    else:
        rows = rows.filter(c("claim_status") == "Rejected")
        customers = customers.filter(c("complaint_ix_id").isNotNull())
        texts = _review_texts(
            c("claim_id"), c("category"), c("claim_amount"), c("rejection_reason"), c("complaint_ix_id"), c("complaint_quote")
        )
    joined = join_to_unique(rows, customers, "customer_id", ["claim_id"], "inner")
    return _offers(joined, Rule(code, F.lit(True), *texts).offer())


def eligible_actions(scored: DataFrame, claims: DataFrame, insights: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Every action every customer qualifies for, one row per claim for the claim rules."""
    per_customer = F.array_compact(F.array(*[F.when(r.applies, r.offer()) for r in customer_rules()]))
    # One pass over the 360 frame serves all four customer rules.
    from_customers = _offers(scored, F.explode(per_customer))
    out = from_customers
    for code in CLAIM_ACTIONS:
        out = out.unionByName(claim_offers(scored, claims, insights, as_of, code))
    return out


def _first_offers(scored: DataFrame, claims: DataFrame, insights: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The 360 rows of customers that qualify for something, with their first offer in ``_first``.

    Claims and complaints arrive as one row per customer, so there is no fan-out, no
    ranking window and no join that a hot customer could unbalance.
    """
    c = F.col
    pending, rejected = c("pending_claim"), c("rejected_claim")
    frame = scored.join(oldest_actionable_claims(claims, as_of), "customer_id", "left").join(
        latest_complaint(insights), "customer_id", "left"
    )
    days = days_between(pending["claim_date"], as_date(as_of))
    escalate = _escalation_texts(pending["claim_id"], pending["category"], pending["claim_amount"], days, c("complaint_quote"))
    review = _review_texts(
        rejected["claim_id"],
        rejected["category"],
        rejected["claim_amount"],
        rejected["rejection_reason"],
        c("complaint_ix_id"),
        c("complaint_quote"),
    )
    rules = [
        Rule("CLAIM_ESCALATION", pending.isNotNull(), *escalate),
        Rule("CLAIM_REVIEW", rejected.isNotNull() & c("complaint_ix_id").isNotNull(), *review),
        *customer_rules(),
    ]
    rules.sort(key=lambda r: PRIORITY[r.code])
    first = F.coalesce(*[F.when(r.applies, r.offer()) for r in rules])
    return frame.withColumn("_first", first).filter(c("_first").isNotNull())


def best_actions(scored: DataFrame, claims: DataFrame, insights: DataFrame, as_of: dt.date | str) -> DataFrame:
    """At most one action per customer: the first rule that applies in priority order."""
    return _offers(_first_offers(scored, claims, insights, as_of), F.col("_first"))


def number_recommendations(picked: DataFrame, start: int | Column = 0) -> DataFrame:
    return with_ids(picked, ["priority", "customer_id"], "recommendation_id", "NBA", start)


# --- rationale, confidence, compliance -------------------------------------------------------------

_CONTEXT = (
    "first_name", "last_name", "total_active_premium", "late_payment_count", "avg_sentiment", "total_claims", "rejected_claims",
    "delayed_claims", "churn_signal_count", "competitor_mention_count", "cancellation_intent_count",
    "negative_interaction_count", "total_interactions",
)


def with_context(recommendations: DataFrame, scored: DataFrame) -> DataFrame:
    """Recommendations with the 360 columns that rationale and confidence read."""
    return recommendations.join(scored.select("customer_id", *_CONTEXT), "customer_id")


def rationale() -> Column:
    """Template text that cites the recorded facts only; claim actions report claims, the others payments and mood."""
    c, lit = F.col, F.lit
    head = F.concat(
        c("first_name"), lit(" "), c("last_name"), lit(" ("), c("customer_id").cast("string"), lit(") has a churn risk of "),
        int_text(c("risk_score")), lit("/100 and Rs. "), money_text(c("total_active_premium")), lit(" in active premium. "),
    )
    claims = F.concat(
        lit("Claims on record: "), int_text(c("total_claims")), lit(" total, "), int_text(c("rejected_claims")), lit(" rejected, "),
        int_text(c("delayed_claims")), lit(" pending over 30 days. "),
    )
    mood = F.concat(
        lit("Late payments: "), int_text(c("late_payment_count")), lit("; average sentiment: "), number_text(c("avg_sentiment"), 2), lit(". "),
    )
    tail = F.concat(
        lit("Action: "), c("recommended_action"), lit(". Evidence: "), F.coalesce(c("supporting_evidence"), lit("Limited evidence")),
    )
    body = F.when(c("action_code").isin(*CLAIM_ACTIONS), claims).otherwise(mood)
    return F.concat(head, body, tail)


def _d(value: str) -> Column:
    return F.lit(Decimal(value)).cast("decimal(4,2)")


def confidence() -> Column:
    """Decimal confidence in [0, 1]; NULL for an unknown action code."""
    c = F.col
    base = map_value("action_code", {code: _d(v) for code, v in BASE_CONFIDENCE.items()}, F.lit(None).cast("decimal(4,2)"))
    factors = count_flags(
        c(name) > 0
        for name in (
            "late_payment_count", "rejected_claims", "competitor_mention_count", "cancellation_intent_count",
            "delayed_claims", "negative_interaction_count",
        )
    )

    def step(cond: Column, amount: str) -> Column:
        return F.when(cond, _d(amount)).otherwise(_d("0.00"))

    total = (
        base
        + step(c("churn_signal_count") > 0, "0.15")
        + step(factors >= 3, "0.10")
        + step((c("avg_sentiment") < -0.1) & c("action_code").isin(*CLAIM_ACTIONS, "RETENTION_DISCOUNT"), "0.10")
        - step(c("total_interactions") == 0, "0.20")
        - step((c("action_code") == "PROACTIVE_CALLBACK") & (c("churn_signal_count") <= 1), "0.15")
    )
    clamped = F.least(_d("1.00"), F.greatest(_d("0.00"), total))
    # least/greatest skip NULLs, so an unknown code is kept NULL by hand.
    return F.when(base.isNotNull(), clamped).cast("decimal(4,2)")


def _over_cap() -> Column:
    return (F.col("action_code") == "RETENTION_DISCOUNT") & (F.col("discount_amount") > DISCOUNT_CAP)


def compliance_status(score: str = "confidence_score") -> Column:
    return F.when(F.col(score) < F.lit(REVIEW_BELOW), "NEEDS_HUMAN_REVIEW").when(_over_cap(), "FLAGGED").otherwise("COMPLIANT")


def review_reason(score: str = "confidence_score") -> Column:
    return F.when(F.col(score) < F.lit(REVIEW_BELOW), "Confidence below threshold").when(_over_cap(), "Discount exceeds cap")


_ASSESSMENT = ("rationale", "confidence_score", "compliance_status", "review_reason")


def _assessed(with_facts: DataFrame) -> DataFrame:
    return with_facts.withColumns({"rationale": rationale(), "confidence_score": confidence()}).withColumns(
        {"compliance_status": compliance_status(), "review_reason": review_reason()}
    )


def assess(recommendations: DataFrame, scored: DataFrame) -> DataFrame:
    """Stored recommendations with rationale, confidence, compliance status and review reason."""
    kept = [c for c in recommendations.columns if c not in _ASSESSMENT]
    return _assessed(with_context(recommendations.select(*kept), scored)).select(*kept, *_ASSESSMENT)


def recommend(scored: DataFrame, claims: DataFrame, insights: DataFrame, as_of: dt.date | str, start: int | Column = 0) -> DataFrame:
    """The full engine: one assessed, numbered recommendation per eligible customer.

    Assessment happens in the pass that picks the action, so the 360 frame is read once.
    """
    offers = _first_offers(scored, claims, insights, as_of).select(
        "customer_id",
        "_first.*",
        F.col("churn_risk_score").alias("risk_score"),
        F.col("total_active_premium").cast("decimal(18,2)").alias("premium_at_risk"),
        *_CONTEXT,
    )
    assessed = _assessed(offers).drop(*_CONTEXT)
    return number_recommendations(assessed, start)


def new_customers(insights: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(customer_id): customers that have insights but no recommendation yet."""
    return insights.select("customer_id").distinct().join(recommendations.select("customer_id").distinct(), "customer_id", "left_anti")


def recommend_new(scored: DataFrame, claims: DataFrame, insights: DataFrame, recommendations: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The full engine for customers new to the recommendations; ids continue those already used.

    The facts are cut down to these customers before anything is aggregated.
    """
    new = written_keys(new_customers(insights, recommendations))
    some, their_claims, their_insights = (df.join(new, "customer_id", "left_semi") for df in (scored, claims, insights))
    return recommend(some, their_claims, their_insights, as_of, highest_number(recommendations, "recommendation_id", "NBA"))


def callback_offers(scored: DataFrame, insights: DataFrame, recommendations: DataFrame) -> DataFrame:
    """The daily rule: a callback for customers that have insights but no recommendation yet."""
    c, lit = F.col, F.lit
    new = new_customers(insights, recommendations)
    watched = scored.filter(c("risk_level").isin(*WATCHED) & (c("negative_interaction_count") >= 1))
    return watched.join(new, "customer_id", "left_semi").select(
        "customer_id",
        lit("PROACTIVE_CALLBACK").alias("action_code"),
        F.concat(lit("Schedule callback (risk "), int_text(c("churn_risk_score")), lit(", new data)")).alias("recommended_action"),
        c("churn_risk_score").alias("risk_score"),
        c("total_active_premium").cast("decimal(18,2)").alias("premium_at_risk"),
        F.concat(lit("New interactions. Risk: "), c("risk_level")).alias("supporting_evidence"),
        lit(Decimal("0.65")).cast("decimal(4,2)").alias("confidence_score"),
        lit("COMPLIANT").alias("compliance_status"),
    )


def daily_callbacks(scored: DataFrame, insights: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Numbered callbacks that continue the ids already used."""
    offers = callback_offers(scored, insights, recommendations)
    start = highest_number(recommendations, "recommendation_id", "NBA")
    return with_ids(offers, [F.col("risk_score").desc(), F.col("customer_id")], "recommendation_id", "NBA", start)


RECOMMENDATION_COLUMNS: Sequence[str] = (
    "recommendation_id", "customer_id", "action_code", "recommended_action", "rationale", "supporting_evidence", "risk_score",
    "confidence_score", "compliance_status", "review_reason", "premium_at_risk", "discount_amount",
)


def as_recommendations(df: DataFrame) -> DataFrame:
    """Bring full-engine or daily rows to the stored column list; absent columns become NULL."""
    kinds = {"discount_amount": T.DecimalType(12, 2), "rationale": T.StringType(), "review_reason": T.StringType()}
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in RECOMMENDATION_COLUMNS])
