"""I and J: customer 360, risk scoring, next-best actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import AS_OF
from checks.ctes import number, sql
from checks.registry import query
from holdfast.operators import customer360, decisions, nba, pick, scorecard

# --- I: customer 360 and scores ---------------------------------------------------------------------


@query("i01_policy_agg", sql("select * from policy_agg"))
def policy_agg(d):
    return customer360.policy_agg(d.policies, AS_OF)


@query("i02_claim_agg", sql("select * from claim_agg"))
def claim_agg(d):
    return customer360.claim_agg(d.claims, AS_OF)


@query("i03_payment_agg", sql("select * from payment_agg"))
def payment_agg(d):
    return customer360.payment_agg(d.payments)


@query("i04_interaction_agg", sql("select * from interaction_agg"))
def interaction_agg(d):
    return customer360.interaction_agg(d.insights, AS_OF)


@query("i05_customer_360", sql("select * from frame"))
def customer_360(d):
    return d.frame


_FACTORS = {
    "i06_late_payments": ("pts_late_payments", "late_payment_count"),
    "i07_rejected_claims": ("pts_rejected_claims", "rejected_claims"),
    "i08_delayed_claims": ("pts_outstanding_claims", "delayed_claims"),
    "i09_negative_sentiment": ("pts_negative_sentiment", "recent_avg_sentiment"),
    "i10_competitor": ("pts_competitor", "competitor_mention_count"),
    "i11_cancellation": ("pts_cancellation", "cancellation_intent_count"),
    "i12_renewal": ("pts_renewal_risk", "days_to_renewal"),
    "i13_lapsed": ("pts_lapsed", "lapsed_cancelled_policies"),
}


def _register_factor(name: str, points: str, measure: str) -> None:
    @query(name, sql(f"select customer_id, {measure}, {points} from pointed"))
    def factor(d):
        # Only the aggregate behind this factor is computed; the other joins are pruned.
        return d.scored.select("customer_id", measure, points)


for _name, (_points, _measure) in _FACTORS.items():
    _register_factor(_name, _points, _measure)


@query("i14_score", sql("select customer_id, churn_risk_score from totalled"))
def score(d):
    return d.scored.select("customer_id", "churn_risk_score")


@query("i15_level", sql("select customer_id, churn_risk_score, risk_level from scored"))
def level(d):
    return d.scored.select("customer_id", "churn_risk_score", "risk_level")


@query("i16_explanation", sql("select customer_id, risk_factors from scored"))
def explanation(d):
    return d.scored.select("customer_id", "risk_factors")


_TEST_CARD = sql(
    """select *, case when worry >= 40 then 'red' when worry >= 15 then 'amber' else 'green' end as colour,
    array_to_string(list_filter([case when open_claims > 0 then outstanding_claims || ' open' end,
                                 case when fees > 0 then 'fees ' || total_late_fees end], lambda x: x is not null), '; ') as why
    from (select *, cast(least(50, greatest(0, round(cast(open_claims + fees as double)))) as integer) as worry
          from (select customer_id, outstanding_claims, total_late_fees, least(30, outstanding_claims * 6) as open_claims,
                       case when total_late_fees > 1000 then 25 else 0 end as fees from frame))"""
)


@query("i17_generic_scorecard", _TEST_CARD)
def generic_scorecard(d):
    c, lit = F.col, F.lit
    card = scorecard.Scorecard(
        factors=(
            scorecard.Factor(
                "open_claims",
                scorecard.capped("outstanding_claims", 6, 30),
                lambda p: F.concat(c("outstanding_claims").cast("string"), lit(" open")),
            ),
            scorecard.Factor(
                "fees",
                F.when(c("total_late_fees") > 1000, 25).otherwise(0),
                lambda p: F.concat(lit("fees "), c("total_late_fees").cast("string")),
            ),
        ),
        levels=(("red", 40), ("amber", 15)),
        lowest="green",
        cap=50,
        separator="; ",
        score="worry",
        level="colour",
        reasons="why",
    )
    return scorecard.apply_scorecard(d.frame.select("customer_id", "outstanding_claims", "total_late_fees"), card)


# All facts of a customer as rows of one shape, so that one aggregate gives the whole frame.
_LEGACY_FACTS = """
select customer_id, 'policy' as kind, status, premium_amount as amount, end_date as day, null::double as measure from policies
union all by name select customer_id, 'payment' as kind, status from payments
union all by name select customer_id, 'claim' as kind, status, datediff('day', claim_date, coalesce(resolution_date, date '2001-08-01'))::double as measure from claims
union all by name select customer_id, 'call' as kind, sentiment_score as measure from insights"""

_LEGACY_FRAME = """
select c.customer_id, any_value(first_name || ' ' || last_name) as name, any_value(city) as city, any_value(segment) as segment,
       nullif(count_if(kind = 'policy'), 0) as policy_count, cast(sum(amount) as decimal(18,2)) as total_premium, min(day) as nearest_renewal,
       count_if(kind = 'payment' and status = 'Overdue') as overdue_payments, count_if(kind = 'payment' and status = 'Failed') as failed_payments,
       count_if(kind = 'claim' and status = 'Rejected') as rejected_claims,
       coalesce(avg(measure) filter (where kind = 'claim'), 0.0) as avg_claim_resolution_days,
       coalesce(cast(sum(cast(measure as decimal(18,12))) filter (where kind = 'call') as double) / count(measure) filter (where kind = 'call'), 0.0) as avg_sentiment,
       min(measure) filter (where kind = 'call') as min_sentiment, count_if(kind = 'call' and measure < -0.3) as negative_interactions,
       count_if(kind = 'policy' and status in ('Lapsed', 'Cancelled')) as inactive_policies
from customers c left join legacy_facts using (customer_id) group by c.customer_id"""

# Place, measure, points for one unit, text (none: not printed).
_LEGACY_RULES = """
select * from (values (1, 'overdue', 15, '{n} overdue payment(s)'), (2, 'failed', 10, null), (3, 'rejected', 20, '{n} rejected claim(s)'),
 (4, 'slow', 15, 'Slow claim resolution ({n} days avg)'), (5, 'mood', 20, 'Negative sentiment (avg {n})'), (6, 'negative', 5, '{n} negative interaction(s)'),
 (7, 'renewal', 10, 'Policy renewal within 30 days'), (8, 'inactive', 10, '{n} lapsed/cancelled policy(ies)')) t(place, rule, each, wording)"""

_LEGACY_UNITS = f"""
select customer_id, unnest(['overdue', 'failed', 'rejected', 'slow', 'mood', 'negative', 'renewal', 'inactive']) as rule,
       unnest([overdue_payments, failed_payments, rejected_claims, (avg_claim_resolution_days > 30)::bigint, (avg_sentiment < -0.2)::bigint,
               negative_interactions, coalesce(nearest_renewal <= date '2001-08-31', false)::bigint, inactive_policies]) as units,
       unnest([overdue_payments::varchar, null, rejected_claims::varchar, round(avg_claim_resolution_days)::bigint::varchar, {number("avg_sentiment")},
               negative_interactions::varchar, null, inactive_policies::varchar]) as shown
from legacy_frame"""

_LEGACY = """
select legacy_frame.*, churn_risk_score, case when churn_risk_score >= 60 then 'Critical' when churn_risk_score >= 30 then 'Medium' else 'Low' end as risk_level,
       risk_factors
from legacy_frame join (
  select customer_id, cast(least(100, sum(units * each)) as integer) as churn_risk_score,
         coalesce(string_agg(replace(wording, '{n}', coalesce(shown, '')), ', ' order by place) filter (where units > 0 and wording is not null), '') as risk_factors
  from legacy_units join legacy_rules using (rule) group by customer_id) using (customer_id)"""
_OLD = {"legacy_facts": _LEGACY_FACTS, "legacy_frame": _LEGACY_FRAME, "legacy_rules": _LEGACY_RULES, "legacy_units": _LEGACY_UNITS, "legacy": _LEGACY}


def _legacy(d):
    with_scores = d.interactions.drop("sentiment_score").join(d.insights.select("interaction_id", "sentiment_score"), "interaction_id", "left")
    frame = scorecard.legacy_frame(d.customers, d.policies, d.claims, d.payments, with_scores, AS_OF)
    return scorecard.legacy_score(frame, AS_OF)


@query("i18_legacy_score", sql("select * from legacy", **_OLD))
def legacy_score(d):
    return _legacy(d)


@query(
    "i19_legacy_360",
    sql(
        """select customer_id, 0 as chunk, churn_risk_score, recent_interactions, all_policies
        from legacy left join (select customer_id, string_agg(channel || '/' || strftime(interaction_ts, '%Y-%m-%d') || '/' || sentiment_label, ',' order by rn) as recent_interactions
              from (select *, row_number() over (partition by customer_id order by interaction_ts desc, interaction_id desc) as rn from insights)
              where rn <= 3 group by customer_id) using (customer_id)
        left join (select customer_id, string_agg(policy_id || '/' || premium_amount || '/' || status, ',' order by end_date, policy_id) as all_policies
              from policies group by customer_id) using (customer_id)""",
        **_OLD,
    ),
)
def legacy_360(d):
    c, lit = F.col, F.lit
    ix = F.concat(c("channel"), lit("/"), F.date_format("interaction_ts", "yyyy-MM-dd"), lit("/"), c("sentiment_label"))
    recent = pick.last_n_array(
        d.insights, "customer_id", [c("interaction_ts").desc(), c("interaction_id").desc()], ix, 3, "recent_interactions"
    )
    policy = F.concat(c("policy_id").cast("string"), lit("/"), c("premium_amount").cast("string"), lit("/"), c("status"))
    owned = pick.group_arrays(d.policies, "customer_id", "policy_id", ["end_date"], policy, "all_policies")  # a row for each chunk
    wide = _legacy(d).join(recent, "customer_id", "left").join(owned, "customer_id", "left")
    return wide.select(
        "customer_id",
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        "churn_risk_score",
        F.array_join("recent_interactions", ",").alias("recent_interactions"),
        F.array_join("all_policies", ",").alias("all_policies"),
    )


@query(
    "i20_fact_sheet",
    sql(
        f"""select customer_id, 'Customer: ' || name || ' | City: ' || city || ' | Segment: ' || segment || ' | Policies: ' || coalesce(cast(policy_count as varchar), '0')
        || ' | Total Premium: INR ' || coalesce(cast(total_premium as varchar), '0') || ' | Churn Risk: ' || churn_risk_score || '/100 (' || risk_level
        || ') | Risk Factors: ' || coalesce(risk_factors, 'None') || ' | Overdue Payments: ' || overdue_payments || ' | Rejected Claims: ' || rejected_claims
        || ' | Avg Sentiment: ' || {number("avg_sentiment")} as fact_sheet from legacy""",
        **_OLD,
    ),
)
def fact_sheet(d):
    return scorecard.fact_sheet(_legacy(d))


# --- J: next-best action ----------------------------------------------------------------------------


@query("j01_action_catalog", sql("select action_code, action_name, priority, count(recommendation_id) as in_use from catalog left join recommendations using (action_code) group by all"))
def action_catalog(d):
    used = d.recommendations.groupBy("action_code").agg(F.count("recommendation_id").alias("in_use"))
    return nba.action_catalog(d.spark).join(used, "action_code", "left").select(
        "action_code", "action_name", "priority", F.coalesce("in_use", F.lit(0)).alias("in_use")
    )


@query("j02_claim_evidence", sql("select * from evidence"))
def claim_evidence(d):
    return nba.claim_evidence(d.claims, d.insights, AS_OF)


_COLUMNS = "customer_id, action_code, priority, recommended_action, discount_amount, supporting_evidence, risk_score, premium_at_risk"


def _register_rule(name: str, code: str) -> None:
    @query(name, sql(f"select {_COLUMNS} from eligible where action_code = '{code}'"))
    def rule(d):
        if code in nba.CLAIM_ACTIONS:
            return nba.claim_offers(d.snapshot, d.claims, d.insights, AS_OF, code)
        return nba.rule_offers(d.snapshot, code)


for _name, _code in {
    "j03_claim_escalation": "CLAIM_ESCALATION",
    "j04_claim_review": "CLAIM_REVIEW",
    "j05_retention_discount": "RETENTION_DISCOUNT",
    "j07_payment_plan": "PAYMENT_PLAN",
    "j08_renewal_incentive": "RENEWAL_INCENTIVE",
    "j09_proactive_callback": "PROACTIVE_CALLBACK",
}.items():
    _register_rule(_name, _code)


@query("j06_discount_amount", sql("select customer_id, on_premium as total_active_premium, discount from discounts"))
def discount_amount(d):
    return d.snapshot.select("customer_id", "total_active_premium", nba.discount_amount().alias("discount"))


@query("j10_pick_action", sql(f"select {_COLUMNS} from picked"))
def pick_action(d):
    return nba.best_actions(d.scored, d.claims, d.insights, AS_OF)


@query("j11_recommendation_ids", sql("select recommendation_id, customer_id, action_code from numbered"))
def recommendation_ids(d):
    picked = nba.best_actions(d.snapshot, d.claims, d.insights, AS_OF)
    return nba.number_recommendations(picked).select("recommendation_id", "customer_id", "action_code")


@query("j12_rationale", sql("select recommendation_id, rationale from recommendations"))
def rationale(d):
    rec = d.recommendations.drop("rationale")
    return nba.with_context(rec, d.snapshot).select("recommendation_id", nba.rationale().alias("rationale"))


@query("j13_confidence", sql("select recommendation_id, action_code, confidence_score from recommendations"))
def confidence(d):
    rec = d.recommendations.drop("confidence_score")
    return nba.with_context(rec, d.snapshot).select("recommendation_id", "action_code", nba.confidence().alias("confidence_score"))


@query("j14_compliance", sql("select * from recommendations"))
def compliance(d):
    """The whole engine from the 360 view to compliance."""
    return nba.as_recommendations(nba.recommend(d.scored, d.claims, d.insights, AS_OF))


_KNOWN = "select recommendation_id, customer_id from numbered where action_code <> 'RENEWAL_INCENTIVE'"


@query(
    "j15_new_customers",
    sql(
        """select printf('NBA%05d', (select max(cast(replace(recommendation_id, 'NBA', '') as bigint)) from known)
               + row_number() over (order by priority, customer_id)) as recommendation_id, r.* exclude (recommendation_id)
        from recommendations r join (select action_code, priority from catalog) using (action_code)
        where customer_id in (select customer_id from insights) and customer_id not in (select customer_id from known)""",
        known=_KNOWN,
    ),
)
def recommendations_of_new_customers(d):
    """The full engine for customers that have insights and no recommendation, as if those with a renewal incentive were new."""
    known = d.recommendations.filter(F.col("action_code") != "RENEWAL_INCENTIVE")
    return nba.as_recommendations(nba.recommend_new(d.scored, d.claims, d.insights, known, AS_OF))


@query(
    "j15_daily_callbacks",
    sql(
        """select printf('NBA%05d', (select max(cast(replace(recommendation_id, 'NBA', '') as bigint)) from known)
               + row_number() over (order by churn_risk_score desc, customer_id)) as recommendation_id,
           customer_id, 'PROACTIVE_CALLBACK' as action_code, 'Schedule callback (risk ' || churn_risk_score || ', new data)' as recommended_action,
           churn_risk_score as risk_score, total_active_premium as premium_at_risk, 'New interactions. Risk: ' || risk_level as supporting_evidence,
           cast(0.65 as decimal(4,2)) as confidence_score, 'COMPLIANT' as compliance_status
        from scored where risk_level in ('Critical', 'High', 'Medium') and negative_interaction_count >= 1
          and customer_id in (select customer_id from insights) and customer_id not in (select customer_id from known)""",
        known=_KNOWN,
    ),
)
def daily_callbacks(d):
    # As if renewal incentives had not been issued yet, so some customers are new.
    known = d.recommendations.filter(F.col("action_code") != "RENEWAL_INCENTIVE")
    return nba.daily_callbacks(d.snapshot, d.insights, known)


@query("j16_pending", sql("select recommendation_id, customer_id, action_name, recommended_action, confidence_score from recommendations join catalog using (action_code) where recommendation_id not in (select recommendation_id from log)"))
def pending(d):
    waiting = decisions.pending_with_names(d.recommendations, d.log, nba.action_catalog(d.spark))
    return waiting.select("recommendation_id", "customer_id", "action_name", "recommended_action", "confidence_score")


@query("j17_record_decisions", sql("select * from log"))
def record_decisions(d):
    return decisions.record_decisions(d.recommendations, d.decisions)


@query("j18_recent_decisions", sql("select log_id, customer_id, action_code, decision, left(final_action, 100) as action, decided_by, decided_at from log order by decided_at desc, log_id limit 20"))
def recent_decisions(d):
    return decisions.recent_decisions(d.log)
