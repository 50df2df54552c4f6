"""Quality rules whose cutoffs are certified on labelled documents.

A rule measures a document and rejects it above a cutoff. The cutoffs a rule may take form a fixed ladder, from lenient
to strict, chosen before any label is seen. Labelled good documents are the holdout: a cutoff is certified if, were the
true share of good documents it rejects above the rule's limit, so few rejections as were met would have a probability of
at most the rule's level. That probability is the exact binomial one (a Clopper-Pearson bound). Multiple testing: the level
is divided by the number of strata and rules (Bonferroni); along a ladder cutoffs are tested in order up to the first that
fails, which needs no further correction. So with probability ``1 - level`` no stratum loses more than ``limit`` of its good
documents to the rules together. Of the certified cutoffs the most useful one is taken: rejected low-quality
documents count one, rejected good ones ``price`` against it; without any gain the rule rejects nothing.

Strata are the languages with most labelled documents, at most ``STRATA``; the others are one further stratum.

All of it is DataFrame and SQL functions; each text is read once, and only numbers are stored, joined and grouped.

Cases: a null text is the empty text and fails the base rules like any text of few words; null ids match no label;
a document with several label rows is good if all of them say so; a label counts once for each row with its id;
repeated rows are judged alike; texts of any length are measured whole; without labels, or with too few
for any certificate, only the base rules reject; empty tables give empty results; columns other than
the id, the text and the stratum are not looked at. Repeated windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import stored
from holdfast.operators.skew import join_to_unique

STRATA = 64
WINDOW = 8
_WHITE = r"[\x20\x09-\x0D]+"
_OTHERS = "others"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``value``, a whole number, exceeds the cutoff. ``ladder`` goes from lenient to strict."""

    name: str
    value: str
    ladder: tuple[int, ...]


RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(n_words, 1)", (3000, 2000, 1500, 1000, 700, 500, 350, 250, 150, 100, 60, 30, 10)),
    Rule("duplicate_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", (900, 800, 700, 600, 500, 400, 300, 200, 100, 50)),
    Rule("repeated_words", "1000 * n_repeat_words div greatest(n_words, 1)", (280, 250, 220, 190, 160, 130, 100, 70, 40, 20)),
    Rule("long_words", "1000 * word_chars div greatest(n_words, 1)", (12000, 10000, 9000, 8500, 8000, 7500, 7000, 6500, 6000)),
    Rule("short_words", "-(1000 * word_chars div greatest(n_words, 1))", (-2000, -2500, -3000, -3250, -3500, -3750, -4000, -4250, -4500)),
)


def _joined(hashes: str, by: int) -> Column:
    """Each hash with the one ``by`` places on; the last ``by`` entries stand for nothing."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + by)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed of every row.

    Hashes of windows of eight words come from pairs of pairs of pairs. A document whose runs of four all differ
    repeats no window, so only the others go on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_remove(F.split("text", _WHITE), "").alias("words"),
    )
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("one"))
    rows = rows.select("*", _joined("one", 1).alias("two"))
    rows = rows.select("*", _joined("two", 2).alias("four"))
    none = F.array().cast("array<bigint>")
    may_repeat = (F.size("words") > WINDOW) & (F.size(F.array_distinct("four")) < F.size("four"))
    rows = rows.select("*", F.when(may_repeat, F.slice(_joined("four", 4), F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(none).alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select("*", F.when(repeats, in_order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("ordered"))
    same = lambda x, j: (F.get("ordered", j - 1)["h"] == x["h"]) | (F.get("ordered", j + 1)["h"] == x["h"])
    twice = F.filter("ordered", lambda x, j: F.coalesce(same(x, j), F.lit(False)))
    rows = rows.select("*", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["words"] + p + WINDOW - F.greatest(p, s["end"])).alias("words"), (p + WINDOW).alias("end")),
        lambda s: s["words"],
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def tail_probability(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for a binomial X of ``n`` draws with probability ``p``; summed in logarithms, term by term."""
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.cast("double").alias("term"), F.exp(first).cast("double").alias("total")),
        lambda s, i: F.struct(
            (s["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
            (s["total"] + F.exp(s["term"] + F.log((n - i + 1) / i) + odds)).alias("total"),
        ),
        lambda s: s["total"],
    )


def _binned(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """``bin`` of each row: a name for its stratum."""
    named = F.broadcast(strata.select(F.col("stratum").alias("_stratum"), F.col("bin").alias("_bin")))
    joined = rows.join(named, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("bin", F.coalesce("_bin", F.lit(_OTHERS))).drop("_stratum", "_bin")


def _step(rule: Rule) -> Column:
    """How many cutoffs of the ladder a document stays within; the next one and all stricter ones reject it."""
    within = [F.when(F.expr(rule.value) <= c, 1).otherwise(0) for c in rule.ladder]
    return F.struct(F.lit(rule.name).alias("rule"), sum(within[1:], within[0]).alias("step"))


def certified_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = RULES,
    limit: float = 0.05,
    level: float = 0.05,
    price: int = 10,
    id_col: str = "doc_id",
    good_col: str = "quality",
) -> tuple[DataFrame, DataFrame]:
    """The strata (stratum, bin) and, for each bin and rule that may reject, (bin, rule, cutoff, n_good, false, caught).

    ``measured``: what :func:`features` gave, stored. Of the labels only counts for each stratum, rule and step of a
    ladder come together.
    """
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(good_col).cast("int").alias("good"))
    marks = marks.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    judged = measured.filter("not base_failed and doc_id is not null")
    judged = judged.select("doc_id", "stratum", F.array(*map(_step, rules)).alias("steps"))
    held = join_to_unique(judged, marks, "doc_id", ["doc_id", "stratum"], "inner")
    met = held.select("stratum", F.explode("steps").alias("s"), "good").groupBy("stratum", "s.rule", "s.step")
    met = stored(met.agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad")), "quality-counts")

    sizes = met.groupBy("stratum").agg(F.sum(F.col("good") + F.col("bad")).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.asc_nulls_first("stratum")).limit(STRATA)
    strata = stored(first.select("stratum", F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null")).alias("bin")), "quality-strata")

    # (rule, step, cutoff): a document at a step is rejected by the cutoffs from that step on.
    ladders = [(r.name, k, c) for r in rules for k, c in enumerate(r.ladder)]
    ladder = F.broadcast(met.sparkSession.createDataFrame(ladders, "rule string, k int, cutoff bigint"))
    per_bin = _binned(met, strata).groupBy("bin", "rule", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals = per_bin.groupBy("bin", "rule").agg(F.sum("good").alias("n_good"))
    # One row for each step of a ladder, so the cumulated counts are bounded by bins, rules and steps.
    ladder_rows = totals.join(ladder, "rule").select("bin", "rule", F.col("k").alias("step"), F.lit(0).alias("good"), F.lit(0).alias("bad"), "n_good", "cutoff")
    seen = per_bin.select("bin", "rule", "step", "good", "bad", F.lit(None).cast("bigint").alias("n_good"), F.lit(None).cast("bigint").alias("cutoff"))
    by_step = seen.unionByName(ladder_rows).groupBy("bin", "rule", "step").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("n_good").alias("n_good"), F.max("cutoff").alias("cutoff")
    )
    along = Window.partitionBy("bin", "rule").orderBy("step")
    tested = by_step.withColumn("false", F.sum("good").over(along)).withColumn("caught", F.sum("bad").over(along)).filter("cutoff is not null")
    share = limit / len(rules)
    tests = F.lit(len(rules)) * totals.agg(F.count_distinct("bin")).scalar()
    n, k = F.col("n_good"), F.col("false")
    passed = F.when(k <= n * share, tail_probability(n, k, share) * tests <= level).otherwise(F.lit(False))
    tested = tested.withColumn("_sure", F.min(passed).over(along)).filter("_sure").withColumn("_gain", F.col("caught") - price * F.col("false"))
    best = tested.filter("_gain > 0").groupBy("bin", "rule").agg(
        F.max_by(F.struct("cutoff", "n_good", "false", "caught"), F.struct("_gain", -F.col("step"))).alias("best")
    )
    return strata, best.select("bin", "rule", "best.*")


def judged_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    measured = stored(features(docs, id_col, text_col, stratum_col), "quality-features")
    rules = how.get("rules", RULES)
    strata, cutoffs = certified_cutoffs(measured, labels, id_col=id_col, **how)
    wide = cutoffs.groupBy("bin").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_{r.name}") for r in rules))
    wide = stored(wide, "quality-cutoffs")  # at most STRATA + 1 rows
    joined = _binned(measured, strata).join(F.broadcast(wide), "bin", "left")
    beyond = [F.coalesce(F.expr(f"({r.value}) > _{r.name}"), F.lit(False)) for r in rules]
    rejected = beyond[0]
    for more in beyond[1:]:
        rejected = rejected | more
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
