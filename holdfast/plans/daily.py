"""The daily incremental run and the refresh of the 360 snapshot."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import as_date, day_start, days_between, is_blank
from holdfast.functions.text import TextRules
from holdfast.operators import nba
from holdfast.operators.customer360 import DELAY_DAYS, RECENT_DAYS, customer_360
from holdfast.operators.enrichment import enrich, unprocessed, unprocessed_rows
from holdfast.operators.scorecard import LEVELS, score_customers
from holdfast.operators.pick import one_per_key
from holdfast.operators.writeback import fill_missing, replace_rows
from holdfast.schemas import RUN_LOG
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import written_keys

SNAPSHOT, INSIGHTS, RECOMMENDATIONS, LOG = "customer_360", "interaction_insights", "nba_recommendations", "task_run_log"
STATE = "customer_360_state"
FACT_TABLES = ("customers", "policies", "claims", "payments", INSIGHTS)


@dataclass(frozen=True)
class Facts:
    """The inputs of the 360 frame."""

    customers: DataFrame
    policies: DataFrame
    claims: DataFrame
    payments: DataFrame
    insights: DataFrame

    def frame(self, as_of: dt.date | str) -> DataFrame:
        return customer_360(self.customers, self.policies, self.claims, self.payments, self.insights, as_of)

    def only(self, keys: DataFrame) -> Facts:
        """The same inputs for some customers. The optimizer sees the size of ``keys`` and picks the join."""
        kept = keys.select("customer_id")
        return Facts(
            *[
                df.join(kept, "customer_id", "left_semi")
                for df in (self.customers, self.policies, self.claims, self.payments, self.insights)
            ]
        )


# --- snapshot refresh ------------------------------------------------------------------------------


def changed_by_calendar(snapshot: DataFrame, facts: Facts, before: dt.date | str, as_of: dt.date | str) -> DataFrame:
    """Customers for whom a day boundary lies between the two dates.

    The nearest renewal has passed, a pending claim became overdue, or an interaction left the
    recent window. Every filter is on a plain column and reaches the scan.
    """
    age_then = days_between("claim_date", as_date(before))
    age_now = days_between("claim_date", as_date(as_of))
    overdue = (F.col("status") == "Pending") & (age_then <= DELAY_DAYS) & (age_now > DELAY_DAYS)
    ts = F.col("interaction_ts")
    left_window = (ts >= day_start(before, RECENT_DAYS)) & (ts < day_start(as_of, RECENT_DAYS))
    return (
        snapshot.filter(F.col("nearest_renewal_date") < as_date(as_of))
        .select("customer_id")
        .unionByName(facts.claims.filter(overdue).select("customer_id"))
        .unionByName(facts.insights.filter(left_window).select("customer_id"))
    )


def affected_customers(
    snapshot: DataFrame, facts: Facts, new_rows: Sequence[DataFrame], before: dt.date | str, as_of: dt.date | str
) -> DataFrame:
    """Customers whose row differs from a snapshot taken at ``before``: those of any new row in any
    table, new customers among them, and those that the calendar changed."""
    changed = changed_by_calendar(snapshot, facts, before, as_of) if str(before) != str(as_of) else snapshot.select("customer_id").limit(0)
    for rows in new_rows:
        changed = changed.unionByName(rows.select("customer_id"))
    return changed.distinct()


def refresh_snapshot(snapshot: DataFrame, facts: Facts, affected: DataFrame, as_of: dt.date | str) -> DataFrame:
    """A whole frame with the affected customers recomputed; the others only have their renewal countdown moved.

    The fact tables are cut down to the affected customers before they are aggregated.
    """
    affected = written_keys(affected)
    aged = snapshot.withColumn("days_to_renewal", days_between(as_date(as_of), "nearest_renewal_date"))
    return replace_rows(aged, facts.only(affected).frame(as_of), affected, "customer_id")


# --- the run ---------------------------------------------------------------------------------------


def read_facts(tables: Tables) -> Facts:
    return Facts(*[tables.read(n) for n in FACT_TABLES])


def current_interactions(tables: Tables) -> DataFrame:
    """Raw interactions with sentiment and summary filled from the insights.

    A view: the raw table itself is not rewritten for a day's worth of new rows.
    """
    raw = tables.read("interactions")
    if not tables.exists(INSIGHTS):
        return raw
    return fill_missing(raw, tables.read(INSIGHTS), "interaction_id", ["sentiment_score", "summary"], "sentiment_score")


def compact_interactions(tables: Tables) -> DataFrame:
    """Write the filled interactions as the next version of the raw table."""
    return tables.replace("interactions", current_interactions(tables))


def snapshot(tables: Tables) -> DataFrame:
    """The stored 360 frame. The renewal countdown is counted when it is read, so days that pass rewrite no row."""
    day, _ = snapshot_state(tables)
    return tables.read(SNAPSHOT).withColumn("days_to_renewal", days_between(as_date(day), "nearest_renewal_date"))


def scored_snapshot(tables: Tables, levels: Sequence[tuple[str, int]] = LEVELS) -> DataFrame:
    return score_customers(snapshot(tables), levels)


def stamp(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def enrich_new(tables: Tables, rules: TextRules, now: dt.datetime) -> DataFrame:
    """Enrich and append what is new, each interaction once; returns the stored insights."""
    done = tables.read(INSIGHTS) if tables.exists(INSIGHTS) else None
    raw = tables.read("interactions")
    todo = one_per_key(raw if done is None else unprocessed_rows(raw, done), "interaction_id")
    partitions = tables.spark.sparkContext.defaultParallelism
    return tables.append(INSIGHTS, enrich(todo, rules, partitions=partitions).withColumn("enriched_at", stamp(now)))


def snapshot_state(tables: Tables) -> tuple[str | None, dict[str, str]]:
    """Date of the stored snapshot and the marks of the tables it was made from."""
    row = tables.read(STATE).first() if tables.exists(STATE) else None
    return (row["snapshot_date"], json.loads(row["marks"])) if row else (None, {})


def snapshot_date(tables: Tables) -> str | None:
    return snapshot_state(tables)[0]


def behind(tables: Tables) -> bool:
    """Whether any table has grown or was replaced since the snapshot."""
    _, marks = snapshot_state(tables)
    return any(marks.get(n) != tables.mark(n) for n in FACT_TABLES)


def refresh(tables: Tables, as_of: dt.date | str) -> DataFrame:
    """Bring the stored snapshot up to date, whatever changed.

    The snapshot remembers the last batch of each table it was made from. Rows of later batches,
    in any of the tables, name the customers to recompute, and only their rows are written. It is rebuilt when there is none, when a
    table was replaced, or when ``as_of`` goes back. A batch that arrives meanwhile is counted
    again by the next refresh.
    """
    before, seen = snapshot_state(tables)
    marks = {n: tables.mark(n) for n in FACT_TABLES}
    facts = read_facts(tables)
    if before is None or str(as_of) < before or any(tables.replaced_since(n, seen.get(n, "")) for n in FACT_TABLES):
        tables.replace_keyed(SNAPSHOT, facts.frame(as_of), "customer_id")
    else:
        new_rows = [tables.read_since(n, seen[n]) for n in FACT_TABLES if seen[n] != marks[n]]
        affected = written_keys(affected_customers(tables.read(SNAPSHOT), facts, new_rows, before, as_of))
        if not affected.isEmpty():
            tables.upsert(SNAPSHOT, facts.only(affected).frame(as_of), "customer_id")
    # The state comes last: a run that ends before it computes the same customers again, to the same rows.
    state = tables.spark.createDataFrame([(str(as_of), json.dumps(marks))], "snapshot_date string, marks string")
    tables.replace(STATE, state.coalesce(1))
    tables.vacuum(STATE, keep=2)
    return snapshot(tables)


def log_run(tables: Tables, **fields) -> DataFrame:
    """Append one finished row to the run log."""
    row = tuple(fields.get(f.name) for f in RUN_LOG.fields)
    return tables.append(LOG, tables.spark.createDataFrame([row], RUN_LOG))


def run_id_of(moment: dt.datetime) -> str:
    return f"RUN_{moment:%Y%m%d_%H%M%S}"


def _nothing_to_do(tables: Tables, texts: int) -> bool:
    if texts:
        return False
    if not tables.exists(INSIGHTS):
        return True
    return tables.exists(SNAPSHOT) and not behind(tables)


def add_recommendations(tables: Tables, as_of: dt.date | str, levels: Sequence[tuple[str, int]] = LEVELS, full: bool = False) -> int:
    """Callbacks for customers new to the recommendations, or with ``full`` all actions; the full engine on the first run."""
    insights, scored = tables.read(INSIGHTS), scored_snapshot(tables, levels)
    if not tables.exists(RECOMMENDATIONS):
        return tables.append(
            RECOMMENDATIONS, nba.as_recommendations(nba.recommend(scored, tables.read("claims"), insights, as_of))
        ).count()
    stored = tables.read(RECOMMENDATIONS)
    before = stored.count()
    new = nba.recommend_new(scored, tables.read("claims"), insights, stored, as_of) if full else nba.daily_callbacks(scored, insights, stored)
    added = nba.as_recommendations(new)
    return tables.append(RECOMMENDATIONS, added).count() - before


def run_daily(
    tables: Tables,
    as_of: dt.date | str,
    rules: TextRules,
    levels: Sequence[tuple[str, int]] = LEVELS,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
    full: bool = False,
) -> dict:
    """New interactions -> insights -> snapshot -> callbacks -> run log.

    A failing step is recorded and the others still run (PARTIAL_FAIL). Appends are keyed
    by anti-join, so running again after a crash adds nothing twice. The clock only
    stamps rows; every date rule reads ``as_of``.
    """
    now = clock()
    entry = {"run_id": run_id_of(now), "run_start": now, "new_interactions": 0, "enriched_count": 0, "nba_generated": 0}
    errors, details = [], []

    # Blank transcripts can never be enriched, so they are not counted as new work. Keys and marks meet the insights, never texts.
    raw = tables.read("interactions").select("interaction_id", is_blank("content").alias("blank"))
    todo = unprocessed(raw, tables.read(INSIGHTS)) if tables.exists(INSIGHTS) else raw
    sizes = todo.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("blank")).alias("texts")).first()
    texts, blank = sizes["texts"], sizes["rows"] - sizes["texts"]
    entry["new_interactions"] = texts
    if _nothing_to_do(tables, texts):
        # The stored 360 still has to follow the calendar on a quiet day.
        if snapshot_date(tables) not in (None, str(as_of)):
            refresh(tables, as_of)
        entry |= {"status": "COMPLETED", "run_end": clock(), "details": "No new interactions. Skipped."}
        log_run(tables, **entry)
        return entry
    details.append(f"{texts} new interactions, {blank} without text.")

    try:
        mark = tables.mark(INSIGHTS)
        enrich_new(tables, rules, now)
        entry["enriched_count"] = tables.read_since(INSIGHTS, mark).count()
        details.append(f"{entry['enriched_count']} enriched.")
    except Exception as error:  # recorded; the later steps still run
        errors.append(f"Enrichment: {error}")
        details.append("ENRICHMENT ERROR.")
    try:
        refresh(tables, as_of)
        details.append("360 refreshed.")
    except Exception as error:
        errors.append(f"Snapshot: {error}")
        details.append("SNAPSHOT ERROR.")
    try:
        entry["nba_generated"] = add_recommendations(tables, as_of, levels, full)
        details.append(f"{entry['nba_generated']} new NBAs.")
    except Exception as error:
        errors.append(f"NBA: {error}")
        details.append("NBA ERROR.")

    entry |= {
        "status": "PARTIAL_FAIL" if errors else "COMPLETED",
        "run_end": clock(),
        "error_message": " | ".join(errors) or None,
        "details": " ".join(details),
    }
    log_run(tables, **entry)
    return entry
