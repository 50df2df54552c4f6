"""B to H: projections, joins, aggregates, windows, sorts, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import AS_OF
from checks.ctes import rounded, sql
from checks.registry import query
from holdfast.functions import columns as C
from holdfast.functions import text as X
from holdfast.operators import decisions, enrichment, ids, nba, pick, quality
from holdfast.operators.customer360 import claim_agg, payment_agg, policy_agg, with_coverage
from holdfast.operators.skew import join_to_unique
from holdfast.operators.writeback import fill_missing
from holdfast.plans import metrics, questions

# --- B: projection, filter, predicate ---------------------------------------------------------------


@query("b01_projection", sql("select customer_id, first_name || ' ' || last_name as name, total_active_premium as premium, churn_risk_score as score from scored"))
def projection(d):
    return d.snapshot.select("customer_id", metrics.full_name().alias("name"), F.col("total_active_premium").alias("premium"), F.col("churn_risk_score").alias("score"))


@query("b02_star_plus", sql("select *, total_claims - rejected_claims as accepted_claims from claim_agg"))
def star_plus(d):
    return claim_agg(d.claims, AS_OF).select("*", (F.col("total_claims") - F.col("rejected_claims")).alias("accepted_claims"))


@query("b03_equality", sql("select claim_id, claim_amount from claims where status = 'Pending'"))
def equality(d):
    return d.claims.filter(F.col("status") == "Pending").select("claim_id", "claim_amount")


@query("b04_in_lists", sql("select claim_id, status, category from claims where status in ('Pending', 'Approved') and category not in ('AF', 'NO')"))
def in_lists(d):
    c = F.col
    return d.claims.filter(c("status").isin("Pending", "Approved") & ~c("category").isin("AF", "NO")).select("claim_id", "status", "category")


@query("b05_ranges", sql("select payment_id, amount, due_date from payments where amount >= 1000 and amount < 50000 and due_date > date '1998-06-30' and status <> 'Paid'"))
def ranges(d):
    c = F.col
    cond = (c("amount") >= 1000) & (c("amount") < 50000) & (c("due_date") > F.lit("1998-06-30").cast("date")) & (c("status") != "Paid")
    return d.payments.filter(cond).select("payment_id", "amount", "due_date")


@query("b06_between", sql("select customer_id, late_payment_count from payment_agg where late_payment_count between 1 and 3"))
def between(d):
    return d.snapshot.filter(F.col("late_payment_count").between(1, 3)).select("customer_id", "late_payment_count")


@query("b07_null_tests", sql("select claim_id, status from claims where resolution_date is null or rejection_reason is not null"))
def null_tests(d):
    return d.claims.filter(F.col("resolution_date").isNull() | F.col("rejection_reason").isNotNull()).select("claim_id", "status")


@query("b08_contains", sql("select interaction_id from interactions where lower(content) like '%license%' or lower(content) like '%tionth%'"))
def contains(d):
    return d.interactions.filter(C.contains_any(F.lower("content"), ("License", "licensee", "tionth"))).select("interaction_id")


@query("b09_blank_text", sql("select count(*) as texts from (select case when channel = 'de' then '   ' when channel = 'es' then null else content end as content from interactions) where content is not null and trim(content) <> ''"))
def blank_text(d):
    holes = d.interactions.withColumn(
        "content", F.when(F.col("channel") == "de", "   ").when(F.col("channel") == "es", F.lit(None)).otherwise(F.col("content"))
    )
    return enrichment.with_text(holes).agg(F.count(F.lit(1)).alias("texts"))


@query("b10_compound", sql("select customer_id, risk_level from scored where risk_level in ('Critical', 'High') and total_active_premium > 0 and (competitor_mention_count > 0 or cancellation_intent_count > 0)"))
def compound(d):
    c = F.col
    cond = c("risk_level").isin("Critical", "High") & (c("total_active_premium") > 0) & ((c("competitor_mention_count") > 0) | (c("cancellation_intent_count") > 0))
    return d.snapshot.filter(cond).select("customer_id", "risk_level")


@query("b11_searched_case", sql("select interaction_id, sentiment_label from insights"))
def searched_case(d):
    return d.insights.select("interaction_id", X.sentiment_label("sentiment_score").alias("sentiment_label"))


@query("b12_simple_case", sql("select customer_id, case action_code when 'CLAIM_ESCALATION' then 0.80 when 'CLAIM_REVIEW' then 0.75 when 'RETENTION_DISCOUNT' then 0.70 when 'PAYMENT_PLAN' then 0.70 when 'RENEWAL_INCENTIVE' then 0.60 when 'PROACTIVE_CALLBACK' then 0.55 end as base from picked"))
def simple_case(d):
    base = C.map_value("action_code", nba.BASE_CONFIDENCE).cast("decimal(3,2)")
    return d.recommendations.select("customer_id", base.alias("base"))


@query("b13_typed_nulls", sql("select customer_id, 'CALL' as kind, cast(null as decimal(12,2)) as discount from customers where segment = 'BUILDING' union all select customer_id, 'OFFER', cast(25.5 as decimal(12,2)) from customers where segment <> 'BUILDING'"))
def typed_nulls(d):
    building = F.col("segment") == "BUILDING"
    calls = d.customers.filter(building).select("customer_id", F.lit("CALL").alias("kind"), F.lit(None).cast("decimal(12,2)").alias("discount"))
    offers = d.customers.filter(~building).select("customer_id", F.lit("OFFER").alias("kind"), F.lit("25.5").cast("decimal(12,2)").alias("discount"))
    return calls.unionByName(offers)


@query("b14_multi_filter", sql("select customer_id, segment, risk_level from scored where segment in ('BUILDING', 'MACHINERY')"))
def multi_filter(d):
    return C.multi_filter(d.snapshot, {"segment": ["BUILDING", "MACHINERY"], "risk_level": []}).select("customer_id", "segment", "risk_level")


@query("b15_buckets", sql("select customer_id, case when late_payment_count = 0 then '0 late' when late_payment_count between 1 and 3 then '1-3 late' when late_payment_count between 4 and 6 then '4-6 late' else '7+ late' end as bucket from scored"))
def buckets(d):
    return d.snapshot.select("customer_id", questions.late_payment_bucket().alias("bucket"))


_NAMED_FILTERS = {
    "critical_risk_only": "risk_level = 'Critical'",
    "high_risk_and_above": "risk_level in ('Critical', 'High')",
    "has_competitor_mention": "competitor_mention_count > 0",
    "renewal_within_30_days": "days_to_renewal is not null and days_to_renewal <= 30",
    "has_late_payments": "late_payment_count > 0",
    "has_rejected_claims": "rejected_claims > 0",
}


@query("b16_named_filters", sql(" union all ".join(f"select '{n}' as filter_name, count(*) as customers from scored where {cond}" for n, cond in _NAMED_FILTERS.items())))
def named_filters(d):
    known = metrics.filters()
    one = d.snapshot.agg(*[F.count_if(cond).alias(n) for n, cond in known.items()])
    return one.unpivot([], list(known), "filter_name", "customers")


# --- C: joins ---------------------------------------------------------------------------------------


@query("c01_left_joins", sql("select customer_id, total_policies, total_claims, total_payments, total_interactions from frame"))
def left_joins(d):
    return d.frame.select("customer_id", "total_policies", "total_claims", "total_payments", "total_interactions")


@query("c02_inner_join", sql("select interaction_id, length(content) as characters, primary_intent from interactions join (select interaction_id, primary_intent from insights) using (interaction_id)"))
def inner_join(d):
    found = d.insights.select("interaction_id", "primary_intent")
    return d.interactions.join(found, "interaction_id").select("interaction_id", F.length("content").cast("bigint").alias("characters"), "primary_intent")


@query("c03_join_with_predicates", sql("select customer_id, claim_id, churn_risk_score from scored join evidence using (customer_id) where claim_status = 'Pending' and days_since_claim > 30"))
def join_with_predicates(d):
    pending = d.claims.filter((F.col("status") == "Pending") & (C.days_between("claim_date", C.as_date(AS_OF)) > 30))
    customers = d.snapshot.select("customer_id", "churn_risk_score")
    joined = join_to_unique(pending.select("customer_id", "claim_id"), customers, "customer_id", ["claim_id"], "inner")
    return joined.select("customer_id", "claim_id", "churn_risk_score")


@query("c04_join_latest", sql("select customer_id, claim_id, complaint_ix_id, complaint_quote from evidence"))
def join_latest(d):
    return nba.claim_evidence(d.claims, d.insights, AS_OF).select("customer_id", "claim_id", "complaint_ix_id", "complaint_quote")


@query("c05_anti_join", sql("select recommendation_id, customer_id, action_code from recommendations where recommendation_id not in (select recommendation_id from log)"))
def anti_join(d):
    return decisions.pending(d.recommendations, d.log).select("recommendation_id", "customer_id", "action_code")


@query("c06_semi_join", sql("select customer_id, segment from customers where customer_id in (select customer_id from insights where churn_signal <> 'none')"))
def semi_join(d):
    flagged = d.insights.filter(F.col("churn_signal") != "none").select("customer_id").distinct()
    return d.customers.join(flagged, "customer_id", "left_semi").select("customer_id", "segment")


@query("c07_lookup_join", sql("select customer_id, action_name, priority from recommendations join catalog using (action_code)"))
def lookup_join(d):
    catalog = nba.action_catalog(d.spark).select("action_code", "action_name", "priority")
    return d.recommendations.join(F.broadcast(catalog), "action_code").select("customer_id", "action_name", "priority")


@query("c08_latest_decision", sql("select customer_id, recommendation_id, decision, final_action, decided_by, decided_at from (select *, row_number() over (partition by customer_id order by decided_at desc, log_id desc) as rn from log) where rn = 1"))
def latest_decision(d):
    return decisions.latest_decisions(d.log)


@query(
    "c09_last_three",
    sql(
        """select customer_id, string_agg(interaction_id || ':' || sentiment_label, ',' order by rn) as recent
        from (select *, row_number() over (partition by customer_id order by interaction_ts desc, interaction_id desc) as rn from insights)
        where rn <= 3 group by customer_id"""
    ),
)
def last_three(d):
    item = F.concat(F.col("interaction_id").cast("string"), F.lit(":"), F.col("sentiment_label"))
    order = [F.col("interaction_ts").desc(), F.col("interaction_id").desc()]
    return pick.last_n_array(d.insights, "customer_id", order, item, 3, "recent").withColumn("recent", F.array_join("recent", ","))


@query("c10_orphans", "select o_custkey as customer_id, count(*) as rows from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by o_custkey")
def orphans(d):
    # The test tables have no orphans, so the parent side is narrowed to one segment to get some.
    return quality.orphan_counts(d.policies, "customer_id", d.customers.filter(F.col("segment") == "BUILDING"))


@query("c11_scalar_subquery", sql("select cast(max(cast(replace(recommendation_id, 'NBA', '') as bigint)) as bigint) as highest, count(*) as recommendations from recommendations"))
def scalar_subquery(d):
    highest = ids.highest_number(d.recommendations, "recommendation_id", "NBA")
    return d.recommendations.agg(F.count(F.lit(1)).alias("recommendations")).select(highest.alias("highest"), "recommendations")


@query("c12_matches_per_parent", sql("select customer_id, count(claim_id) as claims from customers left join claims using (customer_id) group by customer_id"))
def matches_per_parent(d):
    counted = d.claims.groupBy("customer_id").agg(F.count("claim_id").alias("claims"))
    return d.customers.select("customer_id").join(counted, "customer_id", "left").select("customer_id", C.or_zero("claims").alias("claims"))


# --- D: aggregation ---------------------------------------------------------------------------------


@query("d01_group_count", sql("select status, count(*) as n from policies group by status"))
def group_count(d):
    return d.policies.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("d02_conditional_count", sql("select customer_id, rejected_claims, pending_claims, delayed_claims from claim_agg"))
def conditional_count(d):
    status = F.col("status")
    old = C.days_between("claim_date", C.as_date(AS_OF)) > 30
    return d.claims.groupBy("customer_id").agg(
        F.count_if(status == "Rejected").alias("rejected_claims"),
        F.count_if(status == "Pending").alias("pending_claims"),
        F.count_if((status == "Pending") & old).alias("delayed_claims"),
    )


@query("d03_conditional_sum", sql("select customer_id, outstanding_claim_amount, total_settled_amount from claim_agg"))
def conditional_sum(d):
    return claim_agg(d.claims, AS_OF).select("customer_id", "outstanding_claim_amount", "total_settled_amount")


@query("d04_conditional_min", sql("select customer_id, nearest_renewal_date from policy_agg"))
def conditional_min(d):
    return policy_agg(d.policies, AS_OF).select("customer_id", "nearest_renewal_date")


@query("d05_conditional_max", sql("select customer_id, last_paid_date from payment_agg"))
def conditional_max(d):
    return payment_agg(d.payments).select("customer_id", "last_paid_date")


@query("d06_sum_avg", sql("select customer_id, cast(sum(amount) as decimal(18,2)) as paid, cast(sum(amount) as double) / count(*) as mean from payments group by customer_id"))
def sum_avg(d):
    total = F.sum("amount")
    return d.payments.groupBy("customer_id").agg(
        total.cast("decimal(18,2)").alias("paid"), (total.cast("double") / F.count("amount")).alias("mean")
    )


@query("d07_trailing_window", sql("select customer_id, recent_avg_sentiment as recent from interaction_agg"))
def trailing_window(d):
    recent = F.col("interaction_ts") >= C.day_start(AS_OF, 90)
    return d.insights.groupBy("customer_id").agg(C.exact_avg(F.when(recent, F.col("sentiment_score"))).alias("recent"))


@query("d08_over_aggregate", sql("select customer_id, days_to_renewal from policy_agg"))
def over_aggregate(d):
    return policy_agg(d.policies, AS_OF).select("customer_id", "days_to_renewal")


@query("d09_distinct_list", sql("select customer_id, string_agg(distinct competitor, ', ' order by competitor) as competitors from insights group by customer_id"))
def distinct_list(d):
    return d.insights.groupBy("customer_id").agg(
        F.expr("listagg(DISTINCT competitor, ', ') WITHIN GROUP (ORDER BY competitor)").alias("competitors")
    )


@query("d10_global", sql("select count(*) as n, cast(sum(premium_amount) as decimal(18,2)) as premium, min(start_date) as first_start, max(end_date) as last_end from policies"))
def global_aggregate(d):
    return d.policies.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("premium_amount").cast("decimal(18,2)").alias("premium"),
        F.min("start_date").alias("first_start"),
        F.max("end_date").alias("last_end"),
    )


@query("d11_group_by_bucket", sql("select case when claim_amount < 20000 then 'small' when claim_amount < 60000 then 'medium' else 'large' end as bucket, count(*) as n from claims group by 1"))
def group_by_bucket(d):
    a = F.col("claim_amount")
    bucket = C.label_ranges([(a < 20000, "small"), (a < 60000, "medium")], "large")
    return d.claims.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("d12_rounded_average", sql(f"select city, {rounded('avg(churn_risk_score)', 1)} as avg_risk from scored group by city"))
def rounded_average(d):
    return d.snapshot.groupBy("city").agg(F.round(F.avg("churn_risk_score"), 1).alias("avg_risk"))


@query("d13_distinct", sql("select distinct customer_id, channel from insights"))
def distinct(d):
    return d.insights.select("customer_id", "channel").distinct()


@query("d14_coverage", sql("select count(*) as total, count(s.sentiment_score) as has_sentiment, count(s.summary) as has_summary, cast(sum(cast(s.sentiment_score as decimal(18,12))) as double) / count(s.sentiment_score) as avg_sentiment from interactions left join insights s using (interaction_id)"))
def coverage(d):
    return with_coverage(fill_missing(d.interactions, d.insights, "interaction_id", ["sentiment_score", "summary"], "sentiment_score"))


@query("d15_open_ended_average", sql("select customer_id, avg(datediff('day', claim_date, coalesce(resolution_date, date '2001-08-01'))) as mean_days, min(claim_date) as first_claim from claims group by customer_id"))
def open_ended_average(d):
    days = C.days_between("claim_date", F.coalesce("resolution_date", C.as_date(AS_OF)))
    return d.claims.groupBy("customer_id").agg(F.avg(days).alias("mean_days"), F.min("claim_date").alias("first_claim"))


@query("d16_group_arrays", sql("select customer_id, 0 as chunk, string_agg(policy_id || ':' || status, ',' order by end_date desc, policy_id desc) as policies, count(*) as n from policies group by customer_id"))
def group_arrays(d):
    item = F.concat(F.col("policy_id").cast("string"), F.lit(":"), F.col("status"))
    arrays = pick.group_arrays(d.policies, "customer_id", "policy_id", ["end_date"], item, "policies")
    newest_first = F.reverse("policies")
    return arrays.select("customer_id", "chunk", F.array_join(newest_first, ",").alias("policies"), F.size("policies").cast("bigint").alias("n"))


@query("d17_duplicate_keys", "select l_orderkey || '-' || l_linenumber as line, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_keys(d):
    lines = d.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    return quality.duplicate_keys(lines, "line")


_COUNTED = ("customers", "policies", "claims", "payments", "interactions")


@query("d18_row_counts", sql(" union all ".join(f"select '{t}' as tbl, count(*) as rows from {t}" for t in _COUNTED)))
def row_counts(d):
    return quality.row_counts({t: getattr(d, t) for t in _COUNTED})


# --- E: windows -------------------------------------------------------------------------------------


@query("e01_latest_per_key", sql("select customer_id, interaction_id, churn_signal from (select *, row_number() over (partition by customer_id order by interaction_ts desc, interaction_id desc) as rn from insights) where rn = 1"))
def latest_per_key(d):
    order = [F.col("interaction_ts").desc(), F.col("interaction_id").desc()]
    return pick.top_per_key(d.insights, ["customer_id"], order).select("customer_id", "interaction_id", "churn_signal")


@query("e02_best_per_key", sql("select customer_id, action_code from picked"))
def best_per_key(d):
    offers = nba.eligible_actions(d.snapshot, d.claims, d.insights, AS_OF)
    return pick.top_per_key(offers, ["customer_id"], [F.col("priority")]).select("customer_id", "action_code")


@query("e03_sequential_ids", sql("select printf('NBA%05d', row_number() over (order by churn_risk_score desc, customer_id)) as id, customer_id from scored"))
def sequential_ids(d):
    return ids.with_ids(d.snapshot.select("customer_id", "churn_risk_score"), [F.col("churn_risk_score").desc(), F.col("customer_id")], "id", "NBA").select("id", "customer_id")


@query(
    "e04_continued_ids",
    sql(
        """select printf('NBA%05d', (select max(cast(replace(recommendation_id, 'NBA', '') as bigint)) from recommendations)
            + row_number() over (order by customer_id)) as id, customer_id
        from customers where customer_id not in (select customer_id from recommendations)"""
    ),
)
def continued_ids(d):
    rest = d.customers.select("customer_id").join(d.recommendations.select("customer_id"), "customer_id", "left_anti")
    start = ids.highest_number(d.recommendations, "recommendation_id", "NBA")
    return ids.with_ids(rest, ["customer_id"], "id", "NBA", start)


@query("e05_dense_numbers", sql("select payment_id, row_number() over (order by due_date, payment_id) as n from payments"))
def dense_numbers(d):
    return ids.dense_numbers(d.payments.select("payment_id", "due_date"), ["due_date", "payment_id"], "n").select("payment_id", "n")


# --- F: sort, limit, top-k --------------------------------------------------------------------------


@query("f01_global_sort", sql("select customer_id, churn_risk_score from scored order by churn_risk_score desc, customer_id"))
def global_sort(d):
    return d.snapshot.select("customer_id", "churn_risk_score").orderBy(F.col("churn_risk_score").desc(), "customer_id")


@query("f02_top_k", sql("select customer_id, churn_risk_score, revenue_at_risk from scored order by churn_risk_score desc, customer_id limit 50"))
def top_k(d):
    return d.snapshot.select("customer_id", "churn_risk_score", "revenue_at_risk").orderBy(F.col("churn_risk_score").desc(), "customer_id").limit(50)


@query("f03_custom_order", sql("select risk_level, count(*) as customers, cast(sum(revenue_at_risk) as decimal(18,2)) as premium from scored group by risk_level"))
def custom_order(d):
    return questions.risk_distribution(d.snapshot)


@query("f04_latest_n", sql("select customer_id, payment_id, cast(rn as integer) as recency from (select *, row_number() over (partition by customer_id order by due_date desc, payment_id) as rn from payments) where rn <= 20"))
def latest_n(d):
    return questions.latest_payments(d.payments).select("customer_id", "payment_id", "recency")


@query("f05_batch_slice", sql("select interaction_id from interactions where interaction_id not in (select interaction_id from insights where sentiment_label = 'positive') order by interaction_id limit 300"))
def batch_slice(d):
    done = d.insights.filter(F.col("sentiment_label") == "positive")
    return enrichment.batch_slice(d.interactions, done, 300).select("interaction_id")


@query("f06_limit", "select 5 as n, 0 as strangers")
def plain_limit(d):
    """Which rows a bare limit takes is free; how many and that they are rows of the table isn't."""
    some = d.policies.limit(5)
    strangers = some.select("policy_id").join(d.policies.select("policy_id"), "policy_id", "left_anti")
    return some.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("strangers", strangers.agg(F.count(F.lit(1)).cast("int")).scalar())


# --- G: set operations ------------------------------------------------------------------------------

_OFFER_COLUMNS = "customer_id, action_code, priority, recommended_action, discount_amount, supporting_evidence, risk_score, premium_at_risk"


@query("g01_union_of_rules", sql(f"select {_OFFER_COLUMNS} from eligible"))
def union_of_rules(d):
    return nba.eligible_actions(d.snapshot, d.claims, d.insights, AS_OF)


@query("g02_union_of_counts", sql("select 'insights' as tbl, count(*) as rows from insights union all select 'recommendations', count(*) from picked"))
def union_of_counts(d):
    return quality.row_counts({"insights": d.insights, "recommendations": d.recommendations})


# --- H: scalar functions ----------------------------------------------------------------------------


@query("h01_coalesce", sql("select customer_id, coalesce(competitors_named, 'none') as named from frame"))
def coalesce(d):
    return d.snapshot.select("customer_id", F.coalesce("competitors_named", F.lit("none")).alias("named"))


@query("h02_nullif", sql("select interaction_id, nullif(churn_signal, 'none') as signal from insights"))
def nullif(d):
    return d.insights.select("interaction_id", F.nullif(F.col("churn_signal"), F.lit("none")).alias("signal"))


@query("h03_least_greatest", sql("select customer_id, least(20, late_payment_count * 5) as capped, greatest(3, rejected_claims) as floored from scored"))
def least_greatest(d):
    return d.snapshot.select("customer_id", F.least(F.lit(20), F.col("late_payment_count") * 5).alias("capped"), F.greatest(F.lit(3), F.col("rejected_claims")).alias("floored"))


@query("h04_round", sql("select policy_id, cast(round(premium_amount * 0.15, 0) as decimal(12,0)) as whole, cast(round(premium_amount * 0.15, 1) as decimal(12,1)) as tenth from policies"))
def round_(d):
    p = F.col("premium_amount")
    share = p * F.lit(nba.DISCOUNT_RATE)
    return d.policies.select(
        "policy_id", F.round(share, 0).cast("decimal(12,0)").alias("whole"), F.round(share, 1).cast("decimal(12,1)").alias("tenth")
    )


@query("h05_arithmetic", sql("select interaction_id, abs(sentiment_score) * 20 - 1 as points from insights"))
def arithmetic(d):
    return d.insights.select("interaction_id", (F.abs("sentiment_score") * 20 - 1).alias("points"))


@query("h06_casts", sql("select customer_id, cast(customer_id as varchar) as id_text, cast(total_active_premium as integer) as whole, try_cast(first_name as integer) as not_a_number from scored"))
def casts(d):
    premium = F.round("total_active_premium", 0).cast("int")
    return d.snapshot.select("customer_id", F.col("customer_id").cast("string").alias("id_text"), premium.alias("whole"), F.col("first_name").try_cast("int").alias("not_a_number"))


@query("h07_datediff", sql("select claim_id, cast(datediff('day', claim_date, date '2001-08-01') as integer) as days from claims"))
def datediff(d):
    return d.claims.select("claim_id", C.days_between("claim_date", C.as_date(AS_OF)).alias("days"))


@query("h08_dateadd", sql("select policy_id, end_date - 90 as remind_on, start_date + interval 1 day as starts_after from policies"))
def dateadd(d):
    after = F.col("start_date").cast("timestamp_ntz") + F.expr("interval 1 day")
    return d.policies.select("policy_id", F.date_sub("end_date", 90).alias("remind_on"), after.alias("starts_after"))


@query("h09_now", sql("select policy_id, true as seen_today from policies where end_date < current_date"))
def now(d):
    stamped = d.policies.withColumn("seen_at", F.current_timestamp()).filter(F.col("end_date") < F.current_date())
    return stamped.select("policy_id", (F.col("seen_at").cast("date") == F.current_date()).alias("seen_today"))


@query("h10_format_time", sql("select interaction_id, 'RUN_' || strftime(interaction_ts, '%Y%m%d_%H%M%S') as run_id from interactions"))
def format_time(d):
    return d.interactions.select("interaction_id", F.concat(F.lit("RUN_"), F.date_format("interaction_ts", "yyyyMMdd_HHmmss")).alias("run_id"))


@query("h11_null_propagation", sql("select claim_id, 'Rejection: ' || rejection_reason as text from claims"))
def null_propagation(d):
    return d.claims.select("claim_id", F.concat(F.lit("Rejection: "), "rejection_reason").alias("text"))


@query("h12_concat", sql("select claim_id, 'Claim ' || claim_id || ' (' || category || ')' as text from claims"))
def concat(d):
    return d.claims.select("claim_id", F.concat(F.lit("Claim "), "claim_id", F.lit(" ("), "category", F.lit(")")).alias("text"))


@query("h13_padded_id", sql("select policy_id, printf('POL%05d', policy_id) as id from policies"))
def padded_id(d):
    return d.policies.select("policy_id", C.numbered_id("POL", F.col("policy_id")).alias("id"))


@query("h14_left", sql("select interaction_id, left(summary, 200) as summary from insights"))
def left(d):
    return d.insights.select("interaction_id", F.left("summary", F.lit(200)).alias("summary"))


@query("h15_trim", sql("select customer_id, trim('  ' || first_name || '  ') as name from customers"))
def trim(d):
    return d.customers.select("customer_id", F.trim(F.concat(F.lit("  "), "first_name", F.lit("  "))).alias("name"))


@query("h16_case_folding", sql("select customer_id, lower(segment) as low, upper(city) as up from customers"))
def case_folding(d):
    return d.customers.select("customer_id", F.lower("segment").alias("low"), F.upper("city").alias("up"))


@query("h17_replace", sql("select recommendation_id, cast(replace(recommendation_id, 'NBA', '') as bigint) as n from recommendations"))
def replace(d):
    return d.recommendations.select("recommendation_id", C.id_number("recommendation_id", "NBA").alias("n"))


_FENCED = r"'```json' || chr(10) || props || chr(10) || '```'"


@query("h18_strip_fences", rf"select event_id, regexp_replace({_FENCED}, '```[a-z]*\n?|```', '', 'g') as bare from events")
def strip_fences(d):
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return d.table("events").select("event_id", enrichment.strip_fences(raw).alias("bare"))


@query("h19_parse_json", "select event_id, cast(json_extract_string(case when event_type = 'error' then '{}' else props end, '$.k') as integer) as k from events")
def parse_json(d):
    # Error events are cut in the middle, so they do not parse.
    raw = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 4)")).otherwise(F.col("props"))
    return d.table("events").select("event_id", F.get_json_object(raw, "$.k").cast("int").alias("k"))


@query("h20_json_path", "select event_id, event_type as kind, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_path(d):
    answer = F.concat(F.lit('{"results":{"kind":"'), "event_type", F.lit('","props":'), "props", F.lit("}}"))
    parsed = F.from_json(answer, "struct<results:struct<kind:string,props:struct<k:bigint>>>")
    return d.table("events").withColumn("j", parsed).select("event_id", F.col("j.results.kind").alias("kind"), F.col("j.results.props.k").alias("k"))


_REASONS = "[case when total_claims > 4 then 'many claims' end, case when late_payment_count > 0 then 'late' end]"


@query("h21_array", sql("select customer_id, len([total_claims, total_policies]) as n, [total_claims, total_policies][2] as second from scored"))
def array(d):
    pair = F.array("total_claims", "total_policies")
    return d.snapshot.select("customer_id", F.size(pair).cast("bigint").alias("n"), F.get(pair, F.lit(1)).alias("second"))


def _reasons():
    return F.array(F.when(F.col("total_claims") > 4, "many claims"), F.when(F.col("late_payment_count") > 0, "late"))


@query("h22_array_compact", sql(f"select customer_id, len(list_filter({_REASONS}, lambda x: x is not null)) as n from scored"))
def array_compact(d):
    return d.snapshot.select("customer_id", F.size(F.array_compact(_reasons())).cast("bigint").alias("n"))


@query("h23_array_to_string", sql(f"select customer_id, array_to_string(list_filter({_REASONS}, lambda x: x is not null), ' | ') as reasons from scored"))
def array_to_string(d):
    return d.snapshot.select("customer_id", F.concat_ws(" | ", F.array_compact(_reasons())).alias("reasons"))


@query("h24_split_items", sql("select customer_id, trim(unnest(string_split(risk_factors, ' | '))) as driver from scored where risk_factors <> ''"))
def split_items(d):
    return d.snapshot.select("customer_id", F.explode(C.split_items("risk_factors")).alias("driver"))


@query("h25_object", sql("select policy_id, '{\"policy_id\":' || policy_id || ',\"status\":\"' || status || '\"}' as object from policies"))
def object_(d):
    return d.policies.select("policy_id", F.to_json(F.struct("policy_id", "status")).alias("object"))


@query("h26_char", sql("select customer_id, first_name || chr(10) || city as lines from customers"))
def char(d):
    return d.customers.select("customer_id", F.concat("first_name", F.char(F.lit(10)), "city").alias("lines"))


@query("h27_stable_id", sql("select log_id, recommendation_id, decision from log"))
def stable_id(d):
    return decisions.record_decisions(d.recommendations, d.decisions).select("log_id", "recommendation_id", "decision")


@query("h28_formatting", sql("select recommendation_id, format('{:,}', cast(round(premium_at_risk, 0) as bigint)) as premium, cast(cast(confidence_score * 100 as integer) as varchar) || '%' as confidence from recommendations"))
def formatting(d):
    return d.recommendations.select("recommendation_id", C.thousands(F.round("premium_at_risk", 0)).alias("premium"), C.percent("confidence_score").alias("confidence"))


@query("h29_current_user", sql("select log_id, decision = 'EDIT' as by_user from log"))
def current_user(d):
    """The user fills in where nobody is named: here on edits."""
    named = d.log.withColumn("decided_by", F.when(F.col("decision") != "EDIT", F.col("decided_by")))
    filled = named.withColumn("by", F.coalesce("decided_by", F.current_user()))
    return filled.select("log_id", (F.col("decided_by").isNull() & (F.col("by") == F.current_user())).alias("by_user"))


@query("h30_flag_sum", sql("select customer_id, (late_payment_count > 0)::integer + (rejected_claims > 0)::integer + (competitor_mention_count > 0)::integer + (cancellation_intent_count > 0)::integer + (delayed_claims > 0)::integer + (negative_interaction_count > 0)::integer as flags from scored"))
def flag_sum(d):
    names = ("late_payment_count", "rejected_claims", "competitor_mention_count", "cancellation_intent_count", "delayed_claims", "negative_interaction_count")
    return d.snapshot.select("customer_id", C.count_flags(F.col(n) > 0 for n in names).alias("flags"))

