"""K: metric layer, verified queries, dashboard and workspace questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import LOW_LEVELS
from checks.ctes import rounded, sql
from checks.registry import query
from holdfast.operators.decisions import pending_summary
from holdfast.plans import metrics
from holdfast.plans import questions as q

_MEAN = rounded("avg(churn_risk_score)", 1)
_MONEY = "cast(sum(revenue_at_risk) as decimal(18,2))"
_NAME = "first_name || ' ' || last_name as name"
_LOW = {
    "lowered": "select * exclude (risk_level), case when churn_risk_score >= 45 then 'Critical' when churn_risk_score >= 30 then 'High' when churn_risk_score >= 10 then 'Medium' else 'Low' end as risk_level from scored"
}


@query("k01_dimensions", sql(f"select customer_id, first_name || ' ' || last_name as customer_name, age, gender, city, state, segment, preferred_language, risk_level, risk_factors, nearest_renewal_date, nearest_renewal_date as nearest_renewal, competitors_named, last_paid_date from scored"))
def dimensions(d):
    return d.snapshot.select(*[c.alias(n) for n, c in metrics.dimensions().items()])


def _measure_sql(m: metrics.Measure) -> str:
    if m.aggregation == "count":
        return f"count({m.column})"
    if m.aggregation == "avg":
        return rounded(f"avg({m.column})", 4)
    kind = "decimal(18,2)" if m.column in ("total_active_premium", "revenue_at_risk", "outstanding_claim_amount", "total_late_fees") else "bigint"
    return f"cast(sum({m.column}) as {kind})"


@query("k02_measures", sql("select state, " + ", ".join(f"{_measure_sql(m)} as {n}" for n, m in metrics.MEASURES.items()) + " from scored group by state"))
def measures(d):
    out = metrics.metric_query(d.snapshot, ["state"], list(metrics.MEASURES))
    return out.withColumns(
        {n: F.round(n, 4) for n, m in metrics.MEASURES.items() if m.aggregation == "avg"}
        | {n: F.col(n).cast("decimal(18,2)") for n in ("total_active_premium", "revenue_at_risk", "outstanding_claim_amount", "total_late_fees")}
    )


@query("k03_filters", sql("select customer_id, risk_level, late_payment_count, rejected_claims from scored where risk_level in ('Critical', 'High') and late_payment_count > 0 and rejected_claims > 0"))
def named_filters(d):
    kept = metrics.apply_filters(d.snapshot, ["high_risk_and_above", "has_late_payments", "has_rejected_claims"])
    return kept.select("customer_id", "risk_level", "late_payment_count", "rejected_claims")


@query("k04_metric_query", sql("select segment, state, count(customer_id) as customer_count, cast(sum(late_payment_count) as bigint) as late_payment_count from scored where late_payment_count > 0 group by segment, state order by late_payment_count desc, segment, state limit 7"))
def metric_query(d):
    return metrics.metric_query(
        d.snapshot,
        ["segment", "state"],
        ["customer_count", "late_payment_count"],
        where=["has_late_payments"],
        order_by=[F.col("late_payment_count").desc(), "segment", "state"],
        limit=7,
    )


@query("k05_high_risk_count", sql("select risk_level, count(*) as customer_count from lowered where risk_level in ('Critical', 'High') group by risk_level", **_LOW))
def high_risk_count(d):
    return q.high_risk_customer_count(d.snapshot_at(LOW_LEVELS))


@query("k06_revenue_at_risk", sql(f"select risk_level, count(*) as customers, {_MONEY} as total_revenue_at_risk from scored group by risk_level"))
def revenue_at_risk(d):
    return q.revenue_at_risk_by_level(d.snapshot)


@query("k07_riskiest", sql(f"select customer_id, {_NAME}, city, segment, churn_risk_score, risk_level, revenue_at_risk, risk_factors from scored order by churn_risk_score desc, customer_id limit 10"))
def riskiest(d):
    return q.riskiest_customers(d.snapshot)


@query("k08_risk_by_city", sql(f"select city, count(*) as customers, {_MEAN} as avg_risk_score, {_MONEY} as revenue_at_risk from scored group by city"))
def risk_by_city(d):
    return q.churn_risk_by_city(d.snapshot)


@query("k09_competitor_summary", sql(f"select risk_level, count(*) as customers, cast(sum(competitor_mention_count) as bigint) as total_mentions, {_MEAN} as avg_risk_score, {_MONEY} as revenue_at_risk from scored where competitor_mention_count > 0 group by risk_level"))
def competitor_summary(d):
    return q.competitor_mention_summary(d.snapshot)


@query("k10_segment_breakdown", sql(f"select segment, count(*) as customers, count(*) filter (where risk_level in ('Critical', 'High')) as at_risk, {_MEAN} as avg_risk_score, cast(sum(total_active_premium) as decimal(18,2)) as total_premium from scored group by segment"))
def segment_breakdown(d):
    return q.segment_risk_breakdown(d.snapshot)


@query("k11_renewal_risk", sql(f"select customer_id, {_NAME}, nearest_renewal_date, days_to_renewal, churn_risk_score, risk_level, total_active_premium, risk_factors from scored where days_to_renewal is not null and days_to_renewal <= 30 and risk_level in ('Critical', 'High')"))
def renewal_risk(d):
    return q.renewal_risk_customers(d.snapshot)


@query("k12_late_payment_impact", sql(f"select case when late_payment_count = 0 then '0 late' when late_payment_count between 1 and 3 then '1-3 late' when late_payment_count between 4 and 6 then '4-6 late' else '7+ late' end as late_payment_bucket, count(*) as customers, {_MEAN} as avg_risk_score, {_MONEY} as revenue_at_risk from scored group by 1"))
def late_payment_impact(d):
    return q.late_payment_impact(d.snapshot)


@query("k13_sentiment_vs_churn", sql(f"select case when recent_avg_sentiment >= 0.2 then 'Positive' when recent_avg_sentiment <= -0.2 then 'Negative' else 'Neutral' end as sentiment_bucket, count(*) as customers, {_MEAN} as avg_risk_score, {_MONEY} as revenue_at_risk from scored group by 1"))
def sentiment_vs_churn(d):
    return q.sentiment_vs_churn(d.snapshot)


@query("k14_critical_customers", sql(f"select customer_id, {_NAME}, city, segment, churn_risk_score, active_policies, total_active_premium, late_payment_count, rejected_claims, competitor_mention_count, competitors_named, risk_factors from lowered where risk_level = 'Critical'", **_LOW))
def critical_customers(d):
    return q.critical_customers(d.snapshot_at(LOW_LEVELS))


@query("k15_kpi_row", sql(f"select count(*) as total_customers, count(*) filter (where risk_level in ('Critical', 'High')) as at_risk, {_MONEY} as total_revenue, {_MEAN} as avg_risk from scored where segment in ('BUILDING', 'HOUSEHOLD') and risk_level in ('High', 'Medium')"))
def kpi_row(d):
    return q.kpi_row(d.snapshot, {"segment": ["BUILDING", "HOUSEHOLD"], "risk_level": ["High", "Medium"]})


@query("k16_risk_distribution", sql(f"select risk_level, count(*) as customers, {_MONEY} as premium from scored where segment = 'MACHINERY' group by risk_level"))
def risk_distribution(d):
    return q.risk_distribution(d.snapshot, {"segment": ["MACHINERY"], "risk_level": []})


@query("k17_dashboard_customers", sql(f"select customer_id, {_NAME}, city, segment, risk_level, churn_risk_score as score, total_active_premium as premium, late_payment_count as late_pay, rejected_claims as rej_claims, competitor_mention_count as comp_mentions from scored where risk_level in ('High', 'Medium') order by churn_risk_score desc, customer_id limit 50"))
def dashboard_customers(d):
    return q.dashboard_customers(d.snapshot, {"segment": [], "risk_level": ["High", "Medium"]})


@query("k18_pending_summary", sql(f"select action_code, count(*) as count, cast(sum(premium_at_risk) as decimal(18,2)) as premium_at_risk, {rounded('cast(sum(confidence_score) as double) / count(*)', 2)} as avg_confidence from recommendations where recommendation_id not in (select recommendation_id from log) group by action_code"))
def pending_by_action(d):
    return pending_summary(d.recommendations, d.log)


# Customer 3 stands for the customer the workspace opens with.
_CUSTOMER = 3


@query("k19_customer_lookup", sql(f"select * from scored where customer_id = {_CUSTOMER}".replace("select *", "select * exclude (preferred_language, gender, age)")))
def customer_lookup(d):
    return q.customer_lookup(d.scored, _CUSTOMER).drop("preferred_language", "gender", "age")


@query("k20_policies_tab", sql(f"select policy_id, product_type, vehicle_make || ' ' || vehicle_model as vehicle, premium_amount, status, start_date, end_date from policies where customer_id = {_CUSTOMER}"))
def policies_tab(d):
    return q.customer_policies(d.policies, _CUSTOMER)


@query("k20_claims_tab", sql(f"select claim_id, category, claim_amount, status, claim_date, resolution_date, rejection_reason from claims where customer_id = {_CUSTOMER}"))
def claims_tab(d):
    return q.customer_claims(d.claims, _CUSTOMER)


@query("k20_payments_tab", sql(f"select payment_id, policy_id, amount, status, due_date, paid_date, payment_method, late_fee from payments where customer_id = {_CUSTOMER} order by due_date desc, payment_id limit 20"))
def payments_tab(d):
    return q.customer_payments(d.payments, _CUSTOMER)


_TAB = "interaction_id, channel, sentiment_label, primary_intent, churn_signal, competitor, left(summary, 200) as summary, left(key_quote, 200) as key_quote"


@query("k20_interactions_tab", sql(f"select {_TAB} from insights where customer_id = {_CUSTOMER} order by interaction_ts desc, insights.interaction_id desc limit 10"))
def interactions_tab(d):
    return q.customer_interactions(d.insights, _CUSTOMER)


@query("k20_interactions_portfolio", sql(f"select customer_id, cast(rn as integer) as recency, {_TAB} from (select *, row_number() over (partition by customer_id order by interaction_ts desc, interaction_id desc) as rn from insights) where rn <= 10"))
def interactions_portfolio(d):
    return q.latest_interactions(d.insights)


@query("k21_high_value_renewals", sql(f"select customer_id, {_NAME}, days_to_renewal, total_active_premium, churn_risk_score, risk_level from scored where days_to_renewal <= 60 and total_active_premium >= 10000"))
def high_value_renewals(d):
    return q.high_value_renewals(d.snapshot, 60, 10000)


@query("k22_named_competitor", sql("select customer_id, 0 as chunk, string_agg(interaction_id, ',' order by interaction_id) as interaction_ids from insights where competitor = 'hean' group by customer_id"))
def named_competitor(d):
    return q.competitor_mentions(d.insights, "hean").withColumn("interaction_ids", F.array_join("interaction_ids", ","))


@query(
    "k23_risk_drivers",
    sql(
        """select customer_id, churn_risk_score, risk_level, cast(place as integer) as "at", trim(driver) as driver
        from (select customer_id, churn_risk_score, risk_level, unnest(items) as driver, generate_subscripts(items, 1) as place
              from (select *, string_split(risk_factors, ' | ') as items from scored where risk_factors <> ''))"""
    ),
)
def risk_drivers(d):
    return q.risk_drivers(d.snapshot)


_KINDS = {
    "late payment(s)": "pts_late_payments",
    "rejected claim(s)": "pts_rejected_claims",
    "claim(s) pending >days": "pts_outstanding_claims",
    "Negative sentiment": "pts_negative_sentiment",
    "competitor mention(s)": "pts_competitor",
    "Cancellation intent expressed": "pts_cancellation",
    "Renewal in days": "pts_renewal_risk",
    "lapsed/cancelled policy(ies)": "pts_lapsed",
}


@query("k23_driver_frequency", sql("select * from (" + " union all ".join(f"select '{k}' as driver_kind, count(*) filter (where {p} > 0) as customers from pointed" for k, p in _KINDS.items()) + ") where customers > 0"))
def driver_frequency(d):
    return q.driver_frequency(d.snapshot)
