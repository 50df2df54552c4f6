"""A: scans, sources, sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.binding import AS_OF
from checks.ctes import sql
from checks.registry import query
from holdfast.operators import decisions, nba, writeback
from holdfast.operators.search import search_documents
from holdfast.schemas import CUSTOMERS, POLICIES
from holdfast.sources import csv, tables
from holdfast.sources.workspace import fresh_dir

LOADED_AT = dt.datetime(2001, 8, 1, 2, 0, 0)
_CUSTOMER_LIST = ["customer_id", "first_name", "last_name", "age", "gender", "city", "state", "segment"]


@query(
    "a01_csv_read",
    sql("select cast(customer_id as varchar) as customer_id, first_name, last_name, age, gender, city, state, segment from customers"),
)
def csv_read(d):
    path = fresh_dir(d.spark, "csv")
    csv.write_csv(d.customers, path, _CUSTOMER_LIST)
    schema = type(CUSTOMERS)([CUSTOMERS[c] for c in _CUSTOMER_LIST])
    return csv.read_csv(d.spark, path, schema)


@query(
    "a02_load_with_defaults",
    sql(
        """select cast(policy_id as varchar) as policy_id, cast(customer_id as varchar) as customer_id, product_type, premium_amount,
        start_date, end_date, status, 'Annual' as payment_frequency, 0 as ncb_percentage, true as auto_renew from policies"""
    ),
)
def load_with_defaults(d):
    path, listed = fresh_dir(d.spark, "csv"), ["policy_id", "customer_id", "product_type", "premium_amount", "start_date", "end_date", "status"]
    csv.write_csv(d.policies, path, listed)
    loaded = tables.load(d.tables("load"), "policies", path, LOADED_AT, columns=listed)
    assert loaded.columns == [f.name for f in POLICIES.fields]
    return loaded.select(*listed, "payment_frequency", "ncb_percentage", "auto_renew")


def _csv_folders(d) -> dict[str, str]:
    frames = {
        "customers": d.customers,
        "policies": d.policies,
        "claims": d.claims,
        "payments": d.payments,
        "interactions": d.interactions,
    }
    paths = {}
    for name, df in frames.items():
        listed = [f.name for f in tables.RAW_TABLES[name].fields if f.name != "created_at"]
        full = df.withColumns({c: F.lit(None).cast("string") for c in listed if c not in df.columns})
        paths[name] = fresh_dir(d.spark, f"csv-{name}")
        csv.write_csv(full, paths[name], listed)
    return paths


@query(
    "a03_ordered_load",
    """select 'orphans ' || k as "check", cast(0 as bigint) as expected, cast(0 as bigint) as actual, true as passed
       from (values ('policies.customer_id'), ('claims.policy_id'), ('claims.customer_id'), ('payments.policy_id'),
                    ('payments.customer_id'), ('interactions.customer_id')) t(k)""",
)
def ordered_load(d):
    return tables.load_all(d.tables("load"), _csv_folders(d), LOADED_AT, multiline=True)


@query("a04_csv_write", sql("select cast(claim_id as varchar) as claim_id, status, cast(claim_amount as varchar) as claim_amount from claims"))
def csv_write(d):
    path = fresh_dir(d.spark, "csv")
    csv.write_csv(d.claims, path, ["claim_id", "status", "claim_amount"])
    return d.spark.read.option("header", True).csv(path)


@query("a05_literal_rows", sql("select action_code, action_name, priority, count(r.customer_id) as offers from catalog left join picked r using (action_code, priority) group by all"))
def literal_rows(d):
    offers = d.recommendations.groupBy("action_code").agg(F.count(F.lit(1)).alias("n"))
    return nba.action_catalog(d.spark).join(offers, "action_code", "left").select(
        "action_code", "action_name", "priority", F.coalesce("n", F.lit(0)).alias("offers")
    )


@query("a06_table_rebuild", sql("select channel, count(*) as documents, cast(sum(length(content)) as bigint) as characters from interactions join insights using (interaction_id, channel) group by channel"))
def table_rebuild(d):
    store = d.tables("rebuild")
    docs = search_documents(d.interactions, d.insights)
    store.replace("search_interactions", docs.filter(F.col("sentiment_label") == "negative"))
    rebuilt = store.replace("search_interactions", docs)
    return rebuilt.groupBy("channel").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("original_transcript")).alias("characters")
    )


@query("a07_view", sql("select customer_id, churn_risk_score, risk_level from scored where active_policies > 0"))
def view(d):
    d.scored.createOrReplaceTempView("customer_360")
    return d.spark.sql("SELECT customer_id, churn_risk_score, risk_level FROM customer_360 WHERE active_policies > 0")


@query("a08_append", sql("select status, count(*) as claims, cast(sum(claim_amount) as decimal(18,2)) as amount from claims group by status"))
def append(d):
    store = d.tables("append")
    is_open = F.col("status") == "Pending"
    store.append("claims", d.claims.filter(is_open))
    everything = store.append("claims", d.claims.filter(~is_open))
    return everything.groupBy("status").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").cast("decimal(18,2)").alias("amount")
    )


@query(
    "a09_fill_missing",
    sql(
        """select interaction_id, case when channel = 'en' then 0.5 else i.sentiment_score end as sentiment_score,
        case when channel = 'en' then 'kept' else i.summary end as summary
        from interactions left join (select interaction_id, sentiment_score, summary from insights) i using (interaction_id)"""
    ),
)
def fill_missing(d):
    known = F.col("channel") == "en"
    partly = d.interactions.withColumns({"sentiment_score": F.when(known, 0.5), "summary": F.when(known, "kept")})
    filled = writeback.fill_missing(partly, d.insights, "interaction_id", ["sentiment_score", "summary"], "sentiment_score")
    return d.tables("fill").replace("interactions", filled).select("interaction_id", "sentiment_score", "summary")


@query("a10_keyed_compute", sql("select customer_id, action_code, rationale, confidence_score, compliance_status, review_reason from recommendations"))
def keyed_compute(d):
    bare = d.recommendations.drop("rationale", "confidence_score", "compliance_status", "review_reason")
    updated = d.tables("update").replace("nba_recommendations", nba.assess(bare, d.snapshot))
    return updated.select("customer_id", "action_code", "rationale", "confidence_score", "compliance_status", "review_reason")


@query(
    "a11_audit_append",
    sql(
        """select recommendation_id, customer_id, action_code, 'EDIT' as decision, recommended_action as original_action, 'Call today' as final_action,
        'customer waits' as manager_notes, 'lead' as decided_by, timestamp '2001-08-01 10:00:00' as decided_at
        from recommendations where recommendation_id = 'NBA00001'"""
    ),
)
def audit_append(d):
    one = decisions.one_decision(
        d.spark, "NBA00001", "Edit", "lead", dt.datetime(2001, 8, 1, 10), edited_action="Call today", manager_notes="customer waits"
    )
    return d.tables("audit").append("action_log", decisions.record_decisions(d.recommendations, one)).drop("log_id")


@query("a12_parquet_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice > 300000")
def parquet_scan(d):
    return d.table("orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000)).select("o_orderkey", "o_totalprice")


@query("a13_client_frame", sql("select customer_id, churn_risk_score from scored order by churn_risk_score desc, customer_id limit 100"))
def client_frame(d):
    top = d.snapshot.orderBy(F.col("churn_risk_score").desc(), "customer_id").limit(100).select("customer_id", "churn_risk_score")
    return d.spark.createDataFrame(top.toPandas(), top.schema)


@query("a14_bound_parameters", sql("select customer_id, city, segment from customers where segment = 'BUILDING' and state = 'ASIA'"))
def bound_parameters(d):
    d.customers.createOrReplaceTempView("customers_v")
    return d.spark.sql("SELECT customer_id, city, segment FROM customers_v WHERE segment = ? AND state = ?", args=["BUILDING", "ASIA"])


assert AS_OF == dt.date(2001, 8, 1)  # the oracles spell the date out
