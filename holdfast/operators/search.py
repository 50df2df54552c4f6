"""Transcript search: document assembly, inverted index, BM25 ranking of one query, evidence lookup.

:mod:`segments` has the index that is kept up and ranks tables of queries.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import col
from holdfast.functions.text import WORDS, tokens
from holdfast.operators.pick import top_per_key

K1, B = 1.2, 0.75
SEARCH_LIMIT = 5
SCORE_DIGITS = 6


def search_documents(interactions: DataFrame, insights: DataFrame) -> DataFrame:
    """Transcript joined with its insight as one searchable text plus the filter attributes."""
    found = insights.select(
        "interaction_id", "sentiment_label", "primary_intent", "churn_signal", "competitor", "summary", "key_quote"
    )
    raw = interactions.select("interaction_id", "customer_id", "channel", "direction", "interaction_ts", "content")
    return documents_of(raw.join(found, "interaction_id"))


def documents_of(insights: DataFrame) -> DataFrame:
    """The same from insights that still have their transcript as ``content``, without a join."""
    c, lit = F.col, F.lit
    # The labels inside the searchable text.
    text = F.concat(
        lit("Transcript: "), c("content"),
        lit(" | Summary: "), F.coalesce("summary", lit("")),
        lit(" | Intent: "), F.coalesce("primary_intent", lit("")),
        lit(" | Churn Signal: "), F.coalesce("churn_signal", lit("none")),
        F.when(c("competitor").isNotNull(), F.concat(lit(" | Competitor Mentioned: "), c("competitor"))).otherwise(""),
    )
    return insights.filter(c("interaction_id").isNotNull()).select(
        "interaction_id", "customer_id", "channel", "direction", "interaction_ts", "sentiment_label", "primary_intent",
        "churn_signal", "competitor", text.alias("search_text"), c("content").alias("original_transcript"), "summary", "key_quote",
    )


# --- index -----------------------------------------------------------------------------------------


def plain_words(text: str | Column) -> Column:
    """Lower-cased words of any script, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(text)), WORDS, " "))


def word_array(text: str | Column) -> Column:
    return tokens(text, WORDS)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, length): how often each term occurs in each document.

    A document is one row, so its words are counted where it lies; what moves is one short row
    per document and term, never a text, and a frequent term gathers nowhere.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), word_array(text).alias("_w"))
    return (
        words.select("doc_id", F.size("_w").cast("bigint").alias("length"), F.explode("_w").alias("term"))
        .groupBy("doc_id", "term", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_statistics(docs: DataFrame, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, df): documents per term, reduced on the map side. ``vocabulary`` keeps its terms only."""
    terms = docs.select(F.explode(F.array_distinct(word_array(text))).alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and their total length in words."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(word_array(text))).cast("bigint").alias("n_words"))


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    documents: DataFrame


def build_index(docs: DataFrame, doc_id: str, text: str, attributes: Sequence[str]) -> SearchIndex:
    return SearchIndex(
        postings(docs, doc_id, text),
        term_statistics(docs, text),
        corpus_statistics(docs, text),
        docs.select(F.col(doc_id).alias("doc_id"), *attributes),
    )


def write_index(index: SearchIndex, path: str) -> SearchIndex:
    """Store the index; postings are range-clustered by (term, document).

    Row groups then cover short term ranges, so a search reads few of them, and a term
    found in a third of all documents still spreads over many files.
    """
    spark = index.postings.sparkSession
    laid_out = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    parts = {"postings": laid_out, "terms": index.terms, "corpus": index.corpus, "documents": index.documents}
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return SearchIndex(**{name: spark.read.parquet(f"{path}/{name}") for name in parts})


# --- ranking ---------------------------------------------------------------------------------------


def inverse_frequency(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})


def search(index: SearchIndex, query: str, k: int = SEARCH_LIMIT, where: Column | None = None) -> DataFrame:
    """Best ``k`` documents for one query, optionally among those whose attributes satisfy ``where``.

    The query's words are literals in the filter, so the scan of the stored postings
    skips every row group without them.
    """
    wanted = F.col("term").isin(*query_words(query))
    terms = index.terms.filter(wanted)
    n_docs = index.corpus.select("n_docs").scalar()
    mean = index.corpus.select((F.col("n_words") / F.col("n_docs")).alias("m")).scalar()
    # As many rows as the query has words.
    weights = F.broadcast(terms.select("term", inverse_frequency(F.col("df"), n_docs).alias("idf")))
    scored = (
        index.postings.filter(wanted)
        .join(weights, "term")
        .groupBy("doc_id")
        .agg(F.round(F.sum(F.col("idf") * term_weight(F.col("tf"), F.col("length"), mean)), SCORE_DIGITS).alias("score"))
    )
    documents = index.documents if where is None else index.documents.filter(where)
    return scored.join(documents, "doc_id").orderBy(F.col("score").desc(), "doc_id").limit(k)


# --- evidence --------------------------------------------------------------------------------------

HITS = "struct<results:array<struct<INTERACTION_ID:string,CUSTOMER_ID:string,SUMMARY:string,CHURN_SIGNAL:string>>>"


def unnest_hits(answers: DataFrame, column: str, schema: str = HITS) -> DataFrame:
    """One row per hit of a JSON search answer ``{"results": [...]}``."""
    parsed = answers.withColumn("_hits", F.from_json(F.col(column), schema)["results"])
    kept = [c for c in answers.columns if c != column]
    return parsed.select(*kept, F.inline("_hits"))


def risk_evidence(scored: DataFrame, insights: DataFrame, levels: Sequence[str] = ("Critical", "High"), n: int = 3) -> DataFrame:
    """For customers at the given levels, their latest ``n`` negative or churn-signalling interactions with ids and quotes."""
    telling = insights.filter((F.col("sentiment_label") == "negative") | (F.col("churn_signal") != "none"))
    latest = top_per_key(
        telling.select("customer_id", "interaction_id", "interaction_ts", "sentiment_label", "churn_signal", "competitor", "key_quote"),
        ["customer_id"],
        [F.col("interaction_ts").desc(), F.col("interaction_id").desc()],
        n,
        rank="evidence_rank",
    )
    customers = scored.filter(F.col("risk_level").isin(*levels)).select(
        "customer_id", "churn_risk_score", "risk_level", "risk_factors"
    )
    return customers.join(latest, "customer_id")
