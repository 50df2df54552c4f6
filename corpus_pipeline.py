"""A training corpus from documents: stages that each apply one operator to all rows the stage before kept.

Rows repeated as a whole count as copies, null texts as empty ones; an empty table goes through all stages; further columns
pass through, but for names that begin with ``_dedup_``, ``_join_`` or ``_mix_``, which the stages use themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.bpe import token_digests
from holdfast.llm.common import stored
from holdfast.llm.exact_dedup import drop_exact_duplicates
from holdfast.llm.mixing import mixed_documents
from holdfast.llm.ngram_join import one_of_each_group
from holdfast.llm.queries import vocabulary_path
from holdfast.llm.toxicity import without_toxic


# Documents that are read, and that travel to a Python worker, at a time. Spark's 4,096 and 10,000 hold tens of MB of text.
BATCH_ROWS, _SETTING, _READING = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
# Runs a tokenizing worker remembers, and bytes it splits at a time: the stages before it have filled the executor's heap.
REMEMBERED, SLICE_BYTES = 30_000, 300_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a stage runs and writes its rows; the session has its own setting again afterwards."""
    before = {name: spark.conf.get(name) for name in (_SETTING, _READING)}
    for name in before:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, doesn't reject."""
    with small_batches(spark):
        return stored(without_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")), "corpus-toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text."""
    with small_batches(spark):
        return stored(drop_exact_duplicates(docs), "corpus-exact")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    with small_batches(spark):
        return stored(one_of_each_group(docs, n=5, percent=80), "corpus-near")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    with small_batches(spark):
        return stored(mixed_documents(docs), "corpus-mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row."""
    with small_batches(spark):
        return stored(token_digests(docs, vocabulary_path(), "doc_id", "text", REMEMBERED, SLICE_BYTES), "corpus-tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

# A trained classifier, a similarity join and a tokenizer are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its rows, and the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
