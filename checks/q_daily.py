"""N: incremental runs, streaming, function surface."""

from __future__ import annotations

import datetime as dt
from itertools import count

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.binding import AS_OF, RULES, interactions_from
from checks.ctes import earlier, sql
from checks.registry import query
from holdfast.operators import enrichment
from holdfast.operators.segments import SegmentedIndex
from holdfast.plans import daily
from holdfast.sources.workspace import fresh_dir
from holdfast.streaming.refresh import maintain

# A first run sees the interactions before this day, a second one the rest.
EARLIER = dt.date(2001, 7, 2)
_OLD = "interaction_ts < timestamp '2001-07-02 00:00:00'"
_INSIGHT = "interaction_id, customer_id, channel, direction, interaction_ts, sentiment_score, sentiment_label, primary_intent, churn_signal, competitor, summary, key_quote"


def _is_old():
    return F.col("interaction_ts") < F.lit(f"{EARLIER} 00:00:00").cast("timestamp_ntz")


def _filled(d, label):
    tables = d.tables(label)
    for name in ("customers", "policies", "claims", "payments"):
        tables.replace(name, getattr(d, name))
    tables.replace("interactions", d.interactions.filter(_is_old()))
    return tables


def _clock(day: dt.date):
    """Seconds from two o'clock on, so run ids are known."""
    ticks = count()
    return lambda: dt.datetime.combine(day, dt.time(2)) + dt.timedelta(seconds=next(ticks))


def _two_runs(d, label):
    tables = _filled(d, label)
    daily.run_daily(tables, EARLIER, RULES, clock=_clock(EARLIER))
    tables.append("interactions", d.interactions.filter(~_is_old()))
    daily.run_daily(tables, AS_OF, RULES, clock=_clock(AS_OF))
    return tables


@query("n01_unprocessed", sql(f"select interaction_id from interactions where not ({_OLD})"))
def unprocessed(d):
    return enrichment.unprocessed(d.interactions, d.insights.filter(_is_old())).select("interaction_id")


_RUNS = f"""
select 'RUN_20010702_020000' as run_id, 'COMPLETED' as status, count(*) as new_interactions, count(*) as enriched_count from interactions where {_OLD}
union all select 'RUN_20010801_020000', 'COMPLETED', count(*), count(*) from interactions where not ({_OLD})"""


@query("n02_early_exit", sql(f"select *, false as skipped from ({_RUNS}) union all select 'RUN_20010802_020000', 'COMPLETED', 0, 0, true"))
def early_exit(d):
    tables = _two_runs(d, "exit")
    daily.run_daily(tables, AS_OF, RULES, clock=_clock(dt.date(2001, 8, 2)))
    skipped = F.col("details") == "No new interactions. Skipped."
    return tables.read(daily.LOG).select("run_id", "status", "new_interactions", "enriched_count", skipped.alias("skipped"))


@query("n03_enrich_new", sql("select interaction_id, n.sentiment_score, n.summary from interactions join (select interaction_id, sentiment_score, summary from insights) n using (interaction_id)"))
def enrich_new(d):
    tables = _filled(d, "enrich")
    daily.enrich_new(tables, RULES, dt.datetime(2001, 7, 2, 2))
    tables.append("interactions", d.interactions.filter(~_is_old()))
    daily.enrich_new(tables, RULES, dt.datetime(2001, 8, 1, 2))
    return daily.compact_interactions(tables).select("interaction_id", "sentiment_score", "summary")


@query("n04_refresh", sql("select * from frame"))
def refresh(d):
    """A month-old snapshot brought forward must equal a full rebuild."""
    facts, old = d.facts, d.insights.filter(_is_old())
    past = daily.Facts(facts.customers, facts.policies, facts.claims, facts.payments, old).frame(EARLIER)
    snapshot = d.tables("snapshot").replace("customer_360", past)
    affected = daily.affected_customers(snapshot, facts, [d.insights.filter(~_is_old())], EARLIER, AS_OF)
    return daily.refresh_snapshot(snapshot, facts, affected, AS_OF)


@query("n04_all_tables", sql("select * from frame"))
def refresh_all_tables(d):
    """A snapshot of half of every table, brought forward when the other half has arrived."""
    tables = d.tables("halves")
    keys = {"customers": "customer_id", "policies": "policy_id", "claims": "claim_id", "payments": "payment_id", daily.INSIGHTS: "interaction_id"}
    whole = {n: getattr(d, "insights" if n == daily.INSIGHTS else n) for n in keys}
    half = {n: F.pmod(F.xxhash64(key), F.lit(2)) == 0 for n, key in keys.items()}
    for name, rows in whole.items():
        tables.replace(name, rows.filter(half[name]))
    daily.refresh(tables, EARLIER)
    for name, rows in whole.items():
        tables.append(name, rows.filter(~half[name]))
    return daily.refresh(tables, AS_OF)


_CALLBACKS = """
select recommendation_id, customer_id, action_code, recommended_action, rationale, supporting_evidence, risk_score, confidence_score,
       compliance_status, review_reason, premium_at_risk, discount_amount from recommendations_then
union all
select printf('NBA%05d', (select max(cast(replace(recommendation_id, 'NBA', '') as bigint)) from recommendations_then) + row_number() over (order by churn_risk_score desc, customer_id)),
       customer_id, 'PROACTIVE_CALLBACK', 'Schedule callback (risk ' || churn_risk_score || ', new data)', null, 'New interactions. Risk: ' || risk_level,
       churn_risk_score, cast(0.65 as decimal(4,2)), 'COMPLIANT', null, total_active_premium, null
from scored where risk_level in ('Critical', 'High', 'Medium') and negative_interaction_count >= 1
  and customer_id in (select customer_id from insights) and customer_id not in (select customer_id from recommendations_then)"""


@query("n05_new_recommendations", sql(_CALLBACKS, **earlier("2001-07-02", f"select * from insights where {_OLD}")))
def new_recommendations(d):
    return _two_runs(d, "nba").read(daily.RECOMMENDATIONS)


@query("n06_run_log", sql(_RUNS))
def run_log(d):
    return _two_runs(d, "log").read(daily.LOG).select("run_id", "status", "new_interactions", "enriched_count")


def _streamed(d, label):
    """Insights and snapshot, kept up by the stream over stored facts."""
    documents = d.table("documents")
    source = d.spark.readStream.schema(documents.schema).parquet(f"{d.sf_dir}/{{documents.parquet}}")  # a pattern also takes a single file
    tables = d.tables(label)
    for name in ("customers", "policies", "claims", "payments"):
        tables.replace(name, getattr(d, name))
    customer = d.table("customer")
    running = maintain(
        source, tables, RULES, fresh_dir(d.spark, f"{label}-state"), as_of=AS_OF, prepare=lambda batch: interactions_from(batch, customer)
    )
    running.awaitTermination()
    return tables


@query("n07_stream_refresh", sql(f"select {_INSIGHT} from insights"))
def stream_refresh(d):
    return _streamed(d, "stream").read(daily.INSIGHTS).drop("raw_llm_output", "enriched_at")


@query("n07_stream_snapshot", sql("select * from frame"))
def stream_snapshot(d):
    return daily.snapshot(_streamed(d, "stream-snapshot"))


@query(
    "n07_stream_index",
    sql(
        r"""select cast(interaction_id as varchar) as doc_id, term, count(*) as tf, max(length) as length
        from (select interaction_id, len(words) as length, unnest(words) as term
              from (select interaction_id, list_filter(regexp_split_to_array(lower('Transcript: ' || i.content || ' | Summary: ' || coalesce(n.summary, '') || ' | Intent: '
                      || coalesce(n.primary_intent, '') || ' | Churn Signal: ' || coalesce(n.churn_signal, 'none')
                      || case when n.competitor is not null then ' | Competitor Mentioned: ' || n.competitor else '' end), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words
                    from (select interaction_id, content from interactions) i join insights n using (interaction_id)))
        group by interaction_id, term"""
    ),
)
def stream_index(d):
    """The search index after three streamed batches of files, none of which reads the postings of another."""
    docs, customer = d.table("documents"), d.table("customer")
    files = fresh_dir(d.spark, "files")
    for part in range(3):
        docs.filter(F.pmod("doc_id", F.lit(3)) == part).write.mode("append").parquet(files)
    a_third = max(1, -(-len(d.spark.read.parquet(files).inputFiles()) // 3))
    source = d.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", a_third).parquet(files)
    tables = d.tables("stream-index")
    index = SegmentedIndex(tables, "interaction_id", "search_text", ["churn_signal"])
    maintain(source, tables, RULES, fresh_dir(d.spark, "index-state"), prepare=lambda batch: interactions_from(batch, customer), index=index).awaitTermination()
    return index.postings().withColumn("doc_id", F.col("doc_id").cast("string"))


@query("n08_model_hook", sql("select interaction_id, length(content) - length(replace(content, ' ', '')) as blanks from interactions"))
def model_hook(d):
    texts = d.interactions.select("interaction_id", "content")
    scored = enrichment.apply_text_model(texts, "content", lambda s: s.str.count(" "), "blanks", T.LongType())
    return scored.drop("content")


@query("n09_table_function", "select event_id, part, case part when 'kind' then event_type else cast(json_extract_string(props, '$.k') as varchar) end as text from events, (values ('kind'), ('k')) t(part)")
def table_function(d):
    pairs = F.array(
        F.struct(F.lit("kind").alias("part"), F.col("event_type").alias("text")),
        F.struct(F.lit("k").alias("part"), F.get_json_object("props", "$.k").alias("text")),
    )
    return d.table("events").select("event_id", F.inline(pairs))
