"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.bpe import token_digests
from holdfast.llm.collocations import collocations
from holdfast.llm.exact_dedup import exact_duplicates
from holdfast.llm.main_text import main_texts
from holdfast.llm.merkle import manifest
from holdfast.llm.mixing import SEED, mix_by_source
from holdfast.llm.ngram_join import similar_documents
from holdfast.llm.pii import personal_data
from holdfast.llm.quality_rules import RULES, judged_documents
from holdfast.llm.substrings import substring_dedup
from holdfast.llm.topk import top_k
from holdfast.llm.toxicity import toxicity
from holdfast.llm.url_rules import judge_urls

# Vocabulary files stay outside the repository; this names the one the queries use.
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_exact_dedup",
    f"""
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id is not distinct from max(doc_id) over same as kept, text_sha256
    from (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
    window same as (partition by text_sha256)
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents by a two-pass Bloom filter."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@query(
    "op4_mix_sources",
    rf"""
    with docs as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             ('0x' || left(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 15))::bigint as seed
      from documents),
    sources as (
      select source, sum(size)::bigint as source_size,
             [5, 2, 1][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as weight
      from docs group by source),
    -- Shares that stop at three times the size are the sources with the smallest size for their weight.
    ordered as (
      select *, sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0) as room,
             sum(weight) over () - coalesce(sum(weight) over before, 0) as of_weight
      from sources
      window before as (order by source_size::double / weight, source rows between unbounded preceding and 1 preceding)),
    level as (
      select room, of_weight from ordered where weight * room <= 3 * source_size * of_weight
      order by source_size::double / weight, source limit 1),
    targets as (
      select source, source_size, least(3.0 * source_size, (weight * room)::double / of_weight::double) as target
      from sources, level),
    placed as (
      select doc_id, size, source_size, target, round(target)::bigint as want,
             sum(size) over (partition by source order by seed, size) as upto
      from docs join targets using (source))
    select doc_id, size, source_size, target,
           case when source_size = 0 then 0 else
             size * (want // source_size + (2 * upto - size <= 2 * (want % source_size))::int) end::bigint as taken
    from placed
    """,
)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source."""
    return mix_by_source(_table(spark, sf_dir, "documents"))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public vocabularies keeps a file; every node has that package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return token_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


@query(
    "op2_url_filter",
    r"""
    with cut as (
      select page_id, contains(coalesce(url, ''), '://') as whole,
             regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') as host,
             regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*(/[^?#]*)?', 1) as path
      from pages),
    parts as (
      select page_id, case when whole then translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
             case when whole then path else '' end as path from cut),
    -- Fixed values: the rules.
    rules(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
      ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    best as (
      select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
             max_by(verdict, length(rule_host || rule_path)) as verdict
      from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
      group by page_id)
    select page_id, host, path, rule,
           coalesce(verdict, case when regexp_matches(host || path,
             '^([^/]*[.-])?(adult|casino|bets|cheap-pills|ads-track|spam)([.-][^/]*)?/') then 'block' else 'allow' end) as verdict
    from parts left join best using (page_id)
    """,
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by host rules and block patterns."""
    return judge_urls(_table(spark, sf_dir, "pages"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data(_table(spark, sf_dir, "documents"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return main_texts(_table(spark, sf_dir, "pages"))


@query(
    "op6_top_k",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
    from pairs qualify rank <= 5
    """,
)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


@query(
    "op9_ngram_join",
    f"""
    with recursive words as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents),
    shingles as (
      select distinct doc_id, array_to_string(w[k:k + 2], ' ') as s
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as k from words where len(w) > 0)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    common as (
      select a.doc_id as a, b.doc_id as b, count(*) as both_have
      from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
    links as (
      select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
      where 100 * both_have >= 90 * (x.n + y.n - both_have)),
    reached(doc_id, other) as (
      select doc_id, doc_id from documents union select r.doc_id, l.b from reached r join links l on l.a = r.other)
    select d.doc_id, coalesce(n, 0) as n_shingles, component_id
    from documents d left join sizes using (doc_id)
    join (select doc_id, min(other) as component_id from reached group by doc_id) using (doc_id)
    """,
)
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 3-word shingles."""
    return similar_documents(_table(spark, sf_dir, "documents"))


@query(
    "op10_substring_dedup",
    f"""
    with words as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
    windows as (
      select doc_id, k, array_to_string(w[k:k + 12], ' ') as s
      from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as k from words where len(w) >= 13)),
    gone as (
      select distinct doc_id, unnest(generate_series(k, k + 12)) as place
      from windows join (select s, min(doc_id) as owner from windows group by s) using (s) where owner < doc_id),
    placed as (
      select doc_id, unnest(generate_series(1, len(w))) as place, unnest(w) as word from words),
    kept as (
      select p.doc_id, string_agg(word, ' ' order by place) filter (g.doc_id is null) as txt, count(g.doc_id) as n_removed
      from placed p left join gone g using (doc_id, place) group by p.doc_id)
    select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(txt, '')) as kept_sha256
    from words left join kept using (doc_id)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows of smaller ids."""
    return substring_dedup(_table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    """Bases by windows as strings; the binomial bound by gamma functions, over every cutoff of every rule."""
    ladders = ", ".join(f"('{r.name}', {c})" for r in RULES for c in r.ladder)
    return rf"""
    with d as (
      select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
      from documents),
    win as (
      select rid, k, array_to_string(w[k:k + 7], ' ') as s from (select rid, w, unnest(generate_series(1, len(w) - 7)) as k from d where len(w) >= 8)),
    twice as (select rid, k from (select rid, k, count(*) over (partition by rid, s) as c from win) where c > 1),
    covered as (
      select rid, count(distinct place) as n from (select rid, unnest(generate_series(k, k + 7)) as place from twice) group by rid),
    f as (
      select d.rid, doc_id, lang, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
             len(t) - len(translate(t, '#*$%&|<>', '')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
             coalesce(covered.n, 0) as n_repeat_words
      from d left join covered using (rid)),
    g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f),
    -- Fewer languages than 64: each is a stratum.
    vals as (
      select rid, lang, rule, v from (
        select rid, lang, 'symbols' as rule, 1000 * n_symbols // n_words as v from g where not base_failed
        union all select rid, lang, 'duplicate_lines', 1000 * n_dup_lines // n_lines from g where not base_failed
        union all select rid, lang, 'repeated_words', 1000 * n_repeat_words // n_words from g where not base_failed
        union all select rid, lang, 'long_words', 1000 * word_chars // n_words from g where not base_failed
        union all select rid, lang, 'short_words', -(1000 * word_chars // n_words) from g where not base_failed)),
    marks as (select doc_id, min(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
    held as (select g.rid, g.lang, marks.good from g join marks on g.doc_id = marks.doc_id where not base_failed),
    ladder(rule, cutoff) as (values {ladders}),
    counts as (
      select held.lang, ladder.rule, ladder.cutoff, count(*) filter (good = 1) as n, count(*) filter (good = 1 and v > cutoff) as k,
             count(*) filter (good <> 1 and v > cutoff) as caught
      from held join vals on held.rid = vals.rid join ladder on ladder.rule = vals.rule group by held.lang, ladder.rule, ladder.cutoff),
    tests as (select 5 * count(distinct coalesce(lang, 'null')) as m from counts),
    tails as (
      select counts.lang, counts.rule, counts.cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))) as p
      from (select *, unnest(generate_series(0, k)) as i from counts where k <= n * 0.01) as counts group by counts.lang, counts.rule, counts.cutoff),
    sure as (
      select c.lang, c.rule, c.cutoff, c.caught - 10 * c.k as gain, coalesce(t.p * m <= 0.05, false) as passed
      from counts c cross join tests left join tails t on c.lang is not distinct from t.lang and c.rule = t.rule and c.cutoff = t.cutoff),
    chosen as (
      select lang, rule, max_by(cutoff, gain * 1000000 + cutoff) as cutoff
      from (select *, bool_and(passed) over (partition by lang, rule order by cutoff desc) as certified from sure)
      where certified and gain > 0 group by lang, rule),
    rejected as (select distinct rid from vals join chosen on vals.rule = chosen.rule and vals.lang is not distinct from chosen.lang and v > cutoff)
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
           n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and rejected.rid is null as kept
    from g left join rejected on g.rid = rejected.rid
    """


@query("op11_quality_rules", _quality_sql())
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by rules with certified cutoffs."""
    return judged_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _merkle_sql(levels: int = 9) -> str:
    """The tree level by level as plain tables, for up to 8^``levels`` rows of a language."""
    record = " || ".join(
        f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
    )
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: case when b % 2 = 1 then xor(b // 2, 3988292384) else b // 2 end)), 4294967295)"""
    sql = f"""
    with leaves as (
      select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as tree, sha256({record.format(text="text")}) as leaf,
             case when {crc} % 3 = 0 then sha256({record.format(text=lowered)}) end as changed
      from documents),
    a0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, leaf as d from leaves),
    """
    for k in range(levels):  # a level of more than one node becomes the next; a single node stays
        sql += f"""
    a{k + 1} as (
      select tree, pos // 8 as pos, case when max(whole) = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end as d
      from (select *, count(*) over (partition by tree) as whole from a{k}) group by tree, pos // 8),"""
    sql += f"""
    b0 as (select row_number() over (order by tree) - 1 as pos, tree, d from a{levels}),"""
    for k in range(levels):
        sql += f"""
    b{k + 1} as (
      select pos // 8 as pos, case when max(whole) = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end as d
      from (select *, count(*) over () as whole from b{k}) group by pos // 8),"""
    sql += """
    p0 as (
      select rid, doc_id, tree, leaf, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
             coalesce(changed, leaf) as f, '' as proof
      from leaves),"""

    def step(name: str, before: str, nodes: str, on: str) -> str:
        """Siblings of each row's node on one level, and the node above it in the row's version."""
        return f"""
    {name} as (
      select rid, any_value(doc_id) as doc_id, any_value(p.tree) as tree, any_value(leaf) as leaf, any_value(p.pos) // 8 as pos,
             case when count(*) = 1 and any_value(whole) = 1 then any_value(f)
                  else sha256(string_agg(case when x.pos = p.pos then f else x.d end, '' order by x.pos)) end as f,
             any_value(proof) || coalesce(string_agg(x.d, '' order by x.pos) filter (x.pos <> p.pos), '') as proof
      from {before} p join (select *, count(*) over (partition by {on}) as whole from {nodes}) x
        on {"x.tree = p.tree and " if on == "tree" else ""}x.pos // 8 = p.pos // 8
      group by rid),"""

    for k in range(levels):
        sql += step(f"p{k + 1}", f"p{k}", f"a{k}", "tree")
    sql += f"""
    q0 as (select rid, doc_id, p.tree, leaf, b0.pos, f, proof from p{levels} p join b0 on b0.tree = p.tree),"""
    for k in range(levels):
        sql += step(f"q{k + 1}", f"q{k}", f"b{k}", "1")
    return sql + f"""
    done as (select 1)
    select doc_id, leaf, b0.d as subroot, r.d as root, sha256(proof) as proof_sha256, f as folded_root, f = r.d as verified
    from q{levels} q join b0 on b0.tree = q.tree cross join b{levels} r
    """


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of every document, and the roots of the tampered versions."""
    return manifest(_table(spark, sf_dir, "documents"))


@query(
    "op13_collocations",
    rf"""
    with cut as (
      select coalesce(lang, 'und') as lang, regexp_extract_all({_LOWER}, '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+') as w from documents),
    marked as (select lang, list_transform(w, lambda x: case when regexp_full_match(x, '[.,;:!?\x0A-\x0D]') then null else x end) as w from cut),
    runs as (
      select lang, w[k] as x, w[k + 1] as y, w[k + 2] as z from (select lang, w, unnest(generate_series(1, len(w))) as k from marked)),
    f1 as (select lang, x, count(*)::hugeint as f from runs where x is not null group by lang, x),
    f2 as (select lang, x, y, count(*)::hugeint as f from runs where x is not null and y is not null group by lang, x, y),
    f3 as (select lang, x, y, z, count(*)::hugeint as f from runs where x is not null and y is not null and z is not null group by lang, x, y, z having f >= 10),
    inner_pairs as (
      select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by lang, x, y),
    pairs as (
      select f2.lang, f2.x || ' ' || f2.y as phrase, f2.f as a, 1 as k, l.f as l, r.f as r
      from f2 join f1 l on l.lang = f2.lang and l.x = f2.x join f1 r on r.lang = f2.lang and r.x = f2.y
      left join inner_pairs i on i.lang = f2.lang and i.x = f2.x and i.y = f2.y
      where f2.f >= 10 and not coalesce(100 * i.f >= 50 * f2.f, false)),
    triples as (
      select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z as phrase, f3.f as a, 1 as k, l.f as l, r.f as r
      from f3 join f1 l on l.lang = f3.lang and l.x = f3.x join f2 r on r.lang = f3.lang and r.x = f3.y and r.y = f3.z
      union all
      select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, l.f, r.f
      from f3 join f2 l on l.lang = f3.lang and l.x = f3.x and l.y = f3.y join f1 r on r.lang = f3.lang and r.x = f3.z),
    scored as (select *, (1000000::hugeint * a * a) // (l * r) as score from (select * from pairs union all select * from triples)),
    best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best),
    sums as (select lang, sum(f)::bigint as n from f1 group by lang)
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
    from ranked join sums using (lang) where rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two and three words of each language."""
    return collocations(_table(spark, sf_dir, "documents"))
