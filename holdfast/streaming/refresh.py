"""Lag-bounded maintenance: new interaction files flow into insights, the 360 snapshot and the search index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from holdfast.functions.text import TextRules
from holdfast.operators.enrichment import enrich
from holdfast.operators.pick import one_per_key
from holdfast.operators.search import documents_of
from holdfast.operators.segments import SegmentedIndex
from holdfast.plans.daily import INSIGHTS, refresh, stamp
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import fresh_dir, remove_folder, written_keys

# A date, or a function that gives the date of each batch.
AsOf = dt.date | str | Callable[[], dt.date]


def new_in_batch(batch: DataFrame, done: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Rows of a micro-batch that are not stored yet, each key once.

    The keys of the batch are written, as a stream reads its rows whole each time. The stored keys are first cut down to
    these, so the large side is only scanned for one column, a few known keys are broadcast and no text is shuffled.
    """
    keys = written_keys(batch.select(key))
    known = written_keys(done.select(key).join(keys, key, "left_semi"))
    return one_per_key(batch, key, keys).join(known, key, "left_anti")


def batch_step(
    tables: Tables,
    rules: TextRules,
    as_of: AsOf | None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
    index: SegmentedIndex | None = None,
) -> Callable:
    """Body of ``foreachBatch``. A replayed batch finds its rows stored and adds nothing.

    The index takes the batch before the insights do: if a run ends between the two, the next one finds the
    rows still new and the index passes over those it has.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        if tables.exists(INSIGHTS):
            rows = new_in_batch(rows, tables.read(INSIGHTS))
        else:
            rows = one_per_key(rows, "interaction_id")
        enriched = enrich(rows, rules, keep=() if index is None else ("content",)).withColumn("enriched_at", stamp(clock()))
        if index is not None:
            # With the texts, once; the insights and every step of the index read the same rows.
            path = fresh_dir(tables.spark, "batch")
            enriched.write.parquet(path)
            enriched = tables.spark.read.parquet(path)
            index.add(documents_of(enriched), stored=True)
        tables.append(INSIGHTS, enriched.drop("content"))
        if index is not None:
            remove_folder(tables.spark, path)
        if as_of is not None:
            refresh(tables, as_of() if callable(as_of) else as_of)

    return step


def maintain(
    source: DataFrame,
    tables: Tables,
    rules: TextRules,
    checkpoint: str,
    as_of: AsOf | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = None,
    index: SegmentedIndex | None = None,
) -> StreamingQuery:
    """Start the maintenance query: all available files once, or on an interval such as ``1 hour``.

    With ``as_of`` the 360 snapshot follows each batch; without it only the insights grow. A query
    that runs for days takes a function, called for each batch. With ``index`` the search index follows, too. Intervals without new files run no
    batch; ``plans.daily.refresh`` moves the snapshot on such days.
    """
    writer = source.writeStream.foreachBatch(batch_step(tables, rules, as_of, prepare, index=index)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
