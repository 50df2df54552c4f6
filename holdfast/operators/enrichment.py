"""Transcript enrichment: sentiment, label, summary, intent, churn signal, competitor, quote."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import text as X
from holdfast.functions.columns import col, contains_any, is_blank, known_or
from holdfast.schemas import CHURN_SIGNALS, INTENTS
from holdfast.sources.workspace import spread, written_keys

INSIGHT_COLUMNS = (
    "interaction_id", "customer_id", "channel", "direction", "interaction_ts", "sentiment_score", "sentiment_label",
    "primary_intent", "churn_signal", "competitor", "summary", "key_quote", "raw_llm_output",
)

# Code fences around model output.
FENCES = r"```[a-z]*\n?|```"


def unprocessed(interactions: DataFrame, done: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Rows whose key is not among the done ones; a shuffled anti-join, never a broadcast of all done keys."""
    return interactions.join(done.select(key), key, "left_anti")


def unprocessed_rows(interactions: DataFrame, done: DataFrame, key: str = "interaction_id") -> DataFrame:
    """The same rows with all their columns, found by key first: only keys are shuffled, and a few new ones are broadcast to the texts."""
    new = written_keys(unprocessed(interactions.select(key), done, key).distinct()).withColumnRenamed(key, "_new")
    return interactions.join(new, F.col(key).eqNullSafe(F.col("_new")), "left_semi")


def with_text(interactions: DataFrame) -> DataFrame:
    return interactions.filter(~is_blank("content"))


def batch_slice(interactions: DataFrame, done: DataFrame, max_rows: int, key: str = "interaction_id") -> DataFrame:
    """The first ``max_rows`` unprocessed rows in key order."""
    return unprocessed(interactions, done, key).orderBy(key).limit(max_rows)


def extract(texts: DataFrame, rules: X.TextRules, content: str = "content") -> DataFrame:
    """Add score, label, intent, raw and final signal, competitor, summary and quote, all inside the row.

    The text is scanned once: its lower-cased form and marked sentences leave a generator,
    through which Catalyst does not push filters, so a filter on a derived column cannot
    repeat the scan inside its condition. Nothing is shuffled.
    """
    lowered, score, found = F.col("_lowered"), F.col("sentiment_score"), F.col("_found")
    scan = F.struct(F.lower(col(content)).alias("_lowered"), X.marked_sentences(content, rules.lexicon).alias("_marked"))
    signal = X.apply_rules(rules.signals, lowered, score, rules.default_signal)
    if rules.competitor_signal:
        signal = F.when(
            F.col("competitor").isNotNull() & (signal != rules.override_signal), F.lit(rules.competitor_signal)
        ).otherwise(signal)
    return (
        texts.select("*", F.inline(F.array(scan)))
        .withColumns(
            {
                "_found": X.found_words(F.col("_marked")),
                "_ranked": X.ranked_sentences(F.col("_marked"), rules.markers),
                "competitor": X.first_mention(lowered, rules.competitors),
            }
        )
        .withColumn("sentiment_score", X.sentiment_score(found, rules.positive, rules.negative))
        .withColumns(
            {
                "sentiment_label": X.sentiment_label("sentiment_score"),
                "primary_intent": X.apply_rules(rules.intents, lowered, score, rules.default_intent),
                "extracted_signal": signal,
                "summary": X.summary_of(F.col("_ranked")),
                "key_quote": X.key_quote_of(F.col("_ranked")),
            }
        )
        .withColumn(
            "churn_signal",
            X.override_signal(F.col("extracted_signal"), lowered, rules.cancel_words, rules.override_signal),
        )
        .drop("_lowered", "_marked", "_found", "_ranked")
    )


def enrich(interactions: DataFrame, rules: X.TextRules, done: DataFrame | None = None, partitions: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Insights for every interaction with text that is not done yet; ``partitions`` spreads a few large files, ``keep`` names columns that stay."""
    todo = interactions if done is None else unprocessed(interactions, done)
    # Split sizes are looked at before the filter, which would read the texts.
    todo = with_text(spread(todo.drop("sentiment_score", "summary"), "interaction_id", partitions))
    raw = F.to_json(
        F.struct(
            F.col("primary_intent").alias("intent"),
            F.col("extracted_signal").alias("churn_signal"),
            "competitor",
            "key_quote",
        )
    )
    return extract(todo, rules).withColumn("raw_llm_output", raw).select(*INSIGHT_COLUMNS, *keep)


# --- model output ----------------------------------------------------------------------------------

_MODEL_OUTPUT = "struct<intent:string,churn_signal:string,competitor:string,key_quote:string>"


def strip_fences(raw: str | Column) -> Column:
    return F.regexp_replace(col(raw), FENCES, "")


def parse_model_output(df: DataFrame, raw: str, content: str | None = None, rules: X.TextRules | None = None) -> DataFrame:
    """Tolerant parse of a column of model answers.

    Broken JSON gives the defaults, the text "null" and JSON null give NULL, and values
    outside the enumerations fall back to the default while a flag records them.
    """
    parsed = df.withColumn("_json", F.try_parse_json(F.trim(strip_fences(raw))))
    fields = {f: F.try_variant_get("_json", f"$.{f}", "string") for f in ("intent", "churn_signal", "competitor", "key_quote")}
    parsed = parsed.withColumns({f"_{f}": c for f, c in fields.items()})
    intent, signal = F.col("_intent"), F.col("_churn_signal")
    strange = F.coalesce(~intent.isin(*INTENTS), F.lit(False)) | F.coalesce(~signal.isin(*CHURN_SIGNALS), F.lit(False))
    out = parsed.withColumns(
        {
            "primary_intent": known_or(intent, INTENTS, "general"),
            "churn_signal": known_or(signal, CHURN_SIGNALS, "none"),
            "competitor": F.nullif(F.col("_competitor"), F.lit("null")),
            "key_quote": F.col("_key_quote"),
            "parsed": F.col("_json").isNotNull(),
            "unknown_value": strange,
        }
    )
    if content and rules:
        hit = contains_any(F.lower(col(content)), rules.cancel_words)
        out = out.withColumn("churn_signal", F.when(hit, rules.override_signal).otherwise(F.col("churn_signal")))
    return out.drop("_json", "_intent", "_churn_signal", "_competitor", "_key_quote")


# --- model hook ------------------------------------------------------------------------------------


def apply_text_model(df: DataFrame, content: str, score: Callable, output: str, kind: T.DataType) -> DataFrame:
    """Run a caller's vectorised text model over Arrow batches and add its output column.

    ``score`` takes a pandas Series of texts and returns a Series. It is meant for models
    that have no native expression; partitions are the batches.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, kind)])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(**{output: score(batch[content])})

    return df.mapInPandas(run, schema)
