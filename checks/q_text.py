"""L: text enrichment and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import AS_OF, RULES, stored
from checks.ctes import sql
from checks.registry import query
from holdfast.functions import text as X
from holdfast.operators import enrichment, search, segments, vector_index, vectors
from holdfast.sources.workspace import spread

_INSIGHT = "interaction_id, customer_id, channel, direction, interaction_ts, sentiment_score, sentiment_label, primary_intent, churn_signal, competitor, summary, key_quote"


@query("l01_sentiment", sql("select interaction_id, sentiment_score from insights"))
def sentiment(d):
    texts = spread(d.interactions.select("interaction_id", "content"), "interaction_id", d.spark.sparkContext.defaultParallelism)
    words = texts.select("interaction_id", X.tokens("content").alias("words"))
    return words.select("interaction_id", X.sentiment_score(F.col("words"), RULES.positive, RULES.negative).alias("sentiment_score"))


@query("l02_sentiment_label", sql("select sentiment_label, count(*) as n from insights group by sentiment_label"))
def sentiment_label(d):
    labelled = enrichment.enrich(d.interactions, RULES)
    return labelled.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))


@query("l03_summary", sql("select interaction_id, summary from insights"))
def summary(d):
    return enrichment.extract(d.interactions, RULES).select("interaction_id", "summary")


@query("l04_extraction", sql("select interaction_id, primary_intent, competitor, key_quote, case when churn_signal = 'cancellation_intent' or lower(content) like '%license%' then 'cancellation_intent' else churn_signal end as extracted_signal from insights join (select interaction_id, content from interactions) using (interaction_id)"))
def extraction(d):
    return enrichment.extract(d.interactions, RULES).select("interaction_id", "primary_intent", "competitor", "key_quote", "extracted_signal")


_RAW = """
select event_id, props, cast(json_extract_string(props, '$.k') as integer) as k, event_type,
       '{"intent":"' || case event_type when 'click' then 'complaint' when 'view' then 'browsing' when 'purchase' then 'renewal' else 'payment' end
         || '","churn_signal":"' || case when cast(json_extract_string(props, '$.k') as integer) < 30 then 'price_shock'
                                         when cast(json_extract_string(props, '$.k') as integer) < 60 then 'none' else 'loud' end
         || '","competitor":' || case when cast(json_extract_string(props, '$.k') as integer) < 20 then '"null"'
                                      when cast(json_extract_string(props, '$.k') as integer) < 50 then 'null' else '"Acko"' end
         || ',"key_quote":"k is ' || cast(json_extract_string(props, '$.k') as integer) || '"}' as json
from events"""


def model_answers(d):
    """Model-like answers made from the event log: some fenced, some cut short, some with unknown values."""
    k, kind, lit = F.get_json_object("props", "$.k").cast("int"), F.col("event_type"), F.lit
    intent = F.when(kind == "click", "complaint").when(kind == "view", "browsing").when(kind == "purchase", "renewal").otherwise("payment")
    signal = F.when(k < 30, "price_shock").when(k < 60, "none").otherwise("loud")
    competitor = F.when(k < 20, '"null"').when(k < 50, "null").otherwise('"Acko"')
    text = F.concat(
        lit('{"intent":"'), intent, lit('","churn_signal":"'), signal, lit('","competitor":'), competitor,
        lit(',"key_quote":"k is '), k.cast("string"), lit('"}'),
    )
    fenced = F.concat(lit("```json\n"), text, lit("\n```"))
    cut = F.expr("substring(_text, 1, 40)")
    answers = d.table("events").withColumn("_text", text).withColumn("_fenced", fenced)
    raw = F.when(kind == "click", F.col("_fenced")).when(kind == "error", cut).otherwise(F.col("_text"))
    return answers.select("event_id", raw.alias("raw"))


@query(
    "l05_model_output",
    sql(
        """select event_id, event_type <> 'error' as parsed,
        case when event_type in ('error', 'view') then 'general' else json_extract_string(json, '$.intent') end as primary_intent,
        case when event_type = 'error' or k >= 60 then 'none' else json_extract_string(json, '$.churn_signal') end as churn_signal,
        case when event_type <> 'error' and k >= 50 then 'Acko' end as competitor,
        case when event_type <> 'error' then json_extract_string(json, '$.key_quote') end as key_quote,
        event_type <> 'error' and (event_type = 'view' or k >= 60) as unknown_value from raw_answers""",
        raw_answers=_RAW,
    ),
)
def model_output(d):
    return enrichment.parse_model_output(model_answers(d), "raw").drop("raw")


@query("l06_signal_override", sql("select interaction_id, case when lower(content) like '%license%' then 'cancellation_intent' else 'price_shock' end as churn_signal from interactions"))
def signal_override(d):
    signal = X.override_signal(F.lit("price_shock"), F.lower("content"), RULES.cancel_words, RULES.override_signal)
    return d.interactions.select("interaction_id", signal.alias("churn_signal"))


@query("l07_enrich", sql(f"select {_INSIGHT} from insights where interaction_ts >= timestamp '2001-05-03 00:00:00'"))
def enrich(d):
    done = d.insights.filter(F.col("interaction_ts") < F.lit("2001-05-03 00:00:00").cast("timestamp_ntz"))
    return enrichment.enrich(d.interactions, RULES, done).drop("raw_llm_output")


@query("l07_enrich_all", sql(f"select {_INSIGHT} from insights"))
def enrich_all(d):
    return enrichment.enrich(d.interactions, RULES).drop("raw_llm_output")


_DOCS = """
select interaction_id, customer_id, i.channel, i.direction, i.interaction_ts, sentiment_label, primary_intent, churn_signal, competitor,
       'Transcript: ' || i.content || ' | Summary: ' || coalesce(summary, '') || ' | Intent: ' || coalesce(primary_intent, '')
         || ' | Churn Signal: ' || coalesce(churn_signal, 'none')
         || case when competitor is not null then ' | Competitor Mentioned: ' || competitor else '' end as search_text,
       i.content as original_transcript, summary, key_quote
from interactions i join (select interaction_id, sentiment_label, primary_intent, churn_signal, competitor, summary, key_quote from insights) n using (interaction_id)"""

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_INDEX = {
    "search_docs": _DOCS,
    "doc_words": f"select interaction_id as doc_id, churn_signal, sentiment_label, {_WORDS.format('search_text')} as words from search_docs",
    "doc_terms": "select doc_id, len(words) as length, unnest(words) as term from doc_words",
    "posting_rows": "select doc_id, term, count(*) as tf, max(length) as length from doc_terms group by doc_id, term",
    "term_rows": "select term, count(*) as df from posting_rows group by term",
    "corpus_row": "select count(*) as n_docs, cast(sum(len(words)) as bigint) as n_words from doc_words",
    "weighted": """select p.doc_id, p.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * length / (cast(n_words as double) / n_docs))) as w
                   from posting_rows p join term_rows using (term) cross join corpus_row""",
}


def search_docs(d):
    return stored(d.spark, d.sf_dir, "search_interactions", lambda: search.search_documents(d.interactions, d.insights))


@query("l08_search_documents", sql("select * from search_docs", **_INDEX))
def search_documents(d):
    return search.search_documents(d.interactions, d.insights)


@query("l09_postings", sql("select doc_id, term, tf, length from posting_rows", **_INDEX))
def postings(d):
    return search.postings(search_docs(d), "interaction_id", "search_text")


@query("l09_term_statistics", sql("select term, df from term_rows", **_INDEX))
def term_statistics(d):
    return search.term_statistics(search_docs(d), "search_text")


@query("l09_corpus_statistics", sql("select n_docs, n_words from corpus_row", **_INDEX))
def corpus_statistics(d):
    return search.corpus_statistics(search_docs(d), "search_text")


def _segmented(d):
    index = segments.SegmentedIndex(d.tables("index"), "interaction_id", "search_text", _ATTRIBUTES[2:])
    index.add(search_docs(d))
    return index


_ATTRIBUTES = ("customer_id", "interaction_id", "channel", "sentiment_label", "primary_intent", "churn_signal", "competitor")
_QUERY = "customer said license rewh and that orre"


@query(
    "l10_search",
    sql(
        """select doc_id, round(sum(w), 6) as score, churn_signal, sentiment_label from weighted join doc_words using (doc_id)
        where term in ('customer', 'said', 'license', 'rewh', 'and', 'that', 'orre') and churn_signal <> 'none'
        group by doc_id, churn_signal, sentiment_label order by round(sum(w), 6) desc, doc_id limit 5""",
        **_INDEX,
    ),
)
def search_one(d):
    """One question against a stored index, among documents that carry a churn signal."""
    index = search.build_index(search_docs(d), "interaction_id", "search_text", _ATTRIBUTES)
    written = search.write_index(index, d.tables("index").root)
    hits = search.search(written, _QUERY, where=F.col("churn_signal") != "none")
    return hits.select("doc_id", "score", "churn_signal", "sentiment_label")


@query(
    "l10_search_batch",
    sql(
        rf"""select query_id, cast(rank as integer) as rank, doc_id, score
        from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank
              from (select query_id, doc_id, round(sum(w), 6) as score
                    from (select distinct item_id as query_id, unnest({_WORDS.format('text')}) as term from benchmark) join weighted using (term)
                    group by query_id, doc_id))
        where rank <= 5""",
        **_INDEX,
    ),
)
def search_many(d):
    """Every benchmark text as a question over all search documents."""
    return _segmented(d).search_batch(d.table("benchmark"), "item_id", "text")


@query(
    "l10_search_batch_filtered",
    sql(
        rf"""select query_id, cast(rank as integer) as rank, doc_id, score
        from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank
              from (select query_id, doc_id, round(sum(w), 6) as score
                    from (select distinct item_id as query_id, unnest({_WORDS.format('text')}) as term from benchmark) join weighted using (term)
                         join (select doc_id from doc_words where churn_signal <> 'none') using (doc_id)
                    group by query_id, doc_id))
        where rank <= 3""",
        **_INDEX,
    ),
)
def search_many_filtered(d):
    """Every benchmark text as a question over the documents that carry a churn signal."""
    return _segmented(d).search_batch(d.table("benchmark"), "item_id", "text", k=3, where=F.col("churn_signal") != "none")


@query("l09_segments", sql("select term, df from term_rows", **_INDEX))
def segments_merged(d):
    """Document frequencies of an index that grew by five parts and merged its first segments."""
    index = segments.SegmentedIndex(d.tables("grown"), "interaction_id", "search_text", _ATTRIBUTES[:1])
    docs = search_docs(d)
    for part in range(5):
        index.add(docs.filter(F.pmod(F.xxhash64("interaction_id"), F.lit(5)) == part))
    return index.term_statistics()


_VECTORS = {
    "numbers": "select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings",
    "centres": "select label as query_id, pos, avg(cast(x as double)) as q from numbers group by label, pos",
    "lengths": "select vec_id, sqrt(sum(cast(x as double) * cast(x as double))) as n from numbers group by vec_id",
    "centre_lengths": "select query_id, sqrt(sum(q * q)) as m from centres group by query_id",
    "cosines": """select query_id, vec_id, round(sum(cast(x as double) * q) / max(n * m), 6) as score
                  from numbers join centres using (pos) join lengths using (vec_id) join centre_lengths using (query_id) group by query_id, vec_id""",
}
_TOP = "select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from {0}) where rank <= 5"


@query("l11_vector_search", sql(_TOP.format("cosines"), **_VECTORS))
def vector_search(d):
    """The mean vector of every label as a question over all vectors."""
    corpus = d.table("embeddings")
    return vectors.vector_search(corpus, vectors.centroids(corpus, "label"), "label")


@query("l11_vector_search_filtered", sql(_TOP.format("(select * from cosines join embeddings using (vec_id) where label <> 0)"), **_VECTORS))
def vector_search_filtered(d):
    corpus = d.table("embeddings")
    return vectors.vector_search(corpus, vectors.centroids(corpus, "label"), "label", where=F.col("label") != 0)


@query("l11_index_all_cells", sql(_TOP.format("cosines"), **_VECTORS))
def vector_index_all_cells(d):
    """The inverted file with every cell probed must give the exact hits."""
    corpus = d.table("embeddings")
    index = vector_index.build_vector_index(corpus, d.tables("cells").root)
    return vector_index.approximate_search(index, vectors.centroids(corpus, "label"), "label", probes=1 << 20)


@query("l11_index_recall", "select count(*) * 5 as expected, true as found_nine_of_ten, true as compared_fewer from embeddings where vec_id % 50 = 0")
def vector_index_recall(d):
    """Every fiftieth vector as a question: the cells chosen for the wanted recall against the exact search."""
    corpus = d.table("embeddings")
    asked = corpus.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "asked")
    index = vector_index.build_vector_index(corpus, d.tables("recall").root)
    recall = vector_index.recall_against(vector_index.approximate_search(index, asked, "asked"), vectors.vector_search(corpus, asked, "asked"))
    report = vector_index.probe_report(index, asked, "asked")
    fewer = report.select((F.col("rows_compared") < 0.9 * F.col("rows_indexed")).alias("fewer")).scalar()
    return recall.select("expected", (F.col("recall") >= 0.9).alias("found_nine_of_ten"), fewer.alias("compared_fewer"))


_HITS = "select event_id, cast(event_id as varchar) as INTERACTION_ID, cast(user_id as varchar) as CUSTOMER_ID, event_type as SUMMARY, cast(null as varchar) as CHURN_SIGNAL from events union all select event_id, cast(event_id + 1 as varchar), cast(user_id as varchar), 'next', 'none' from events"


@query("l12_unnest_hits", _HITS)
def unnest_hits(d):
    e, lit = F.col, F.lit
    answer = F.concat(
        lit('{"results":[{"INTERACTION_ID":"'), e("event_id").cast("string"), lit('","CUSTOMER_ID":"'), e("user_id").cast("string"),
        lit('","SUMMARY":"'), e("event_type"), lit('"},{"INTERACTION_ID":"'), (e("event_id") + 1).cast("string"),
        lit('","CUSTOMER_ID":"'), e("user_id").cast("string"), lit('","SUMMARY":"next","CHURN_SIGNAL":"none"}]}'),
    )
    return search.unnest_hits(d.table("events").select("event_id", answer.alias("answer")), "answer")


@query(
    "l13_risk_evidence",
    sql(
        """select customer_id, churn_risk_score, risk_level, risk_factors, interaction_id, interaction_ts, sentiment_label, churn_signal, competitor, key_quote,
           cast(rn as integer) as evidence_rank
        from (select *, row_number() over (partition by customer_id order by interaction_ts desc, interaction_id desc) as rn
              from insights where sentiment_label = 'negative' or churn_signal <> 'none')
        join (select customer_id, churn_risk_score, risk_level, risk_factors from scored) using (customer_id)
        where rn <= 3 and risk_level in ('Critical', 'High')"""
    ),
)
def risk_evidence(d):
    return search.risk_evidence(d.snapshot, d.insights)


assert str(AS_OF) == "2001-08-01"
