"""Mixing sources to target weights with a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network leads from
each pattern, whose words can be used a few times at growing cost, to the quotas of the sources. The flow
says how many words of each pattern go to each source. Per (pattern, source) every document is then taken some full
times, and seeded documents once more until the rest is reached; the last one is taken if that comes nearer.

The driver only sees the totals of patterns and 4096 seed ranges of them at a time, never documents.

Cases: a null text has no words; null is a source of its own, after all others; documents without words take part with
nothing; an empty table gives an empty result; rows repeated as a whole are documents of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import WORD, few_rows, seeded, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20
_LEVEL_BITS = 12
# Columns of the small tables that the driver sends.
_PATTERN, _FULL, _BEFORE = (("pattern", pa.int32()), ("full", pa.int32()), ("before", pa.int64()))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def capped_shares(sizes: Sequence[int], weights: Sequence[int], most_repeats: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of all words by weight; a share stops at ``most_repeats`` times its size and its excess is shared again."""
    total, capped = sum(sizes), set()
    while True:
        free = [j for j in range(len(sizes)) if j not in capped]
        left = total - sum(most_repeats * sizes[j] for j in capped)
        weight = sum(weights[j] for j in free)
        share = {j: Fraction(left * weights[j], weight) for j in free}
        above = {j for j in free if share[j] > most_repeats * sizes[j]}
        if not above:
            return [share[j] if j in share else Fraction(most_repeats * sizes[j]) for j in range(len(sizes))]
        capped |= above


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], most_repeats: int = MOST_REPEATS) -> dict[tuple[int, int], int]:
    """Words that go from pattern to source. ``patterns``: (sources, words).

    Each full use of a pattern costs more than the one before (convex), so words are first used once everywhere
    before any is used again. Successive shortest paths with potentials; the network has one node for each
    pattern and source, and its size doesn't depend on the number of documents.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for i, (sources, words) in enumerate(patterns):
        for use in range(most_repeats):
            edge(start, i, words, use * use)
        for j in sources:
            edge(i, n + j, most_repeats * words, 0)
    for j, quota in enumerate(quotas):
        edge(n + j, end, quota, 0)
    potential = [0] * (n + m + 2)
    while True:
        far: list[float] = [float("inf")] * (n + m + 2)
        by = [-1] * (n + m + 2)
        far[start] = 0
        queue = [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y = to[e]
                if room[e] and (new := d + cost[e] + potential[x] - potential[y]) < far[y]:
                    far[y], by[y] = new, e
                    heapq.heappush(queue, (new, y))
        if by[end] < 0:
            break
        potential = [p + (int(f) if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, x = [], end
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    return {(i, to[e] - n): room[e ^ 1] for i in range(n) for e in out[i] if n <= to[e] < n + m and e % 2 == 0 and room[e ^ 1]}


def source_order(names: Sequence[str | None]) -> list[str | None]:
    """By code point (the order of Python's strings), null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def plan_mix(patterns: Sequence[tuple[Sequence[str | None], int]], weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS):
    """({source: (size, target)}, [(pattern, source, words to take)]) from the words of each pattern."""
    names = source_order({s for sources, _ in patterns for s in sources})
    place = {s: j for j, s in enumerate(names)}
    sizes = [0] * len(names)
    for sources, words in patterns:
        for s in sources:
            sizes[place[s]] += words
    if not names:
        return {}, []
    weight = [weights[j % len(weights)] for j in range(len(names))]
    total = sum(words for _, words in patterns)
    shares = capped_shares(sizes, weight, most_repeats) if total == sum(sizes) else _overlapping_shares(sizes, weight, total, most_repeats)
    flow = min_cost_flow([([place[s] for s in sources], words) for sources, words in patterns], [round(t) for t in shares], most_repeats)
    return (
        {s: (sizes[j], float(shares[j])) for j, s in enumerate(names)},
        [(i, names[j], words) for (i, j), words in sorted(flow.items())],
    )


def _overlapping_shares(sizes, weights, total, most_repeats) -> list[Fraction]:
    """With overlaps the sizes sum to more than all words, which are still what is shared."""
    weight = sum(weights)
    return [min(Fraction(total * w, weight), Fraction(most_repeats * s)) for s, w in zip(sizes, weights, strict=True)]


def _boundary(totals: DataFrame, bucket: str) -> DataFrame:
    """Per pattern: the seed range in which ``want`` is reached, and the words before it. At most 4096 ranges a pattern."""
    order = Window.partitionBy("pattern").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    sums = totals.withColumn("upto", F.sum("words").over(order))
    return (
        sums.filter(F.col("upto") > F.col("want"))
        .groupBy("pattern")
        .agg(F.min(F.struct(bucket, (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        .select("pattern", F.col("at")[bucket].alias(bucket), F.col("at")["before"].alias("before"))
    )


def seed_cuts(sizes: DataFrame, wanted: list[tuple[int, int, int]]) -> DataFrame:
    """One row a pattern: ``full`` times for every document, once more up to and with (``cut_seed``, ``cut_size``).

    ``sizes`` has pattern, size, seed; ``wanted`` (pattern, full times, words of the last time). Two histograms of the
    seed narrow the place where the words are reached down to one of 2**24 ranges; only documents there are ordered.
    """
    spark = sizes.sparkSession
    high, low = 60 - _LEVEL_BITS, 60 - 2 * _LEVEL_BITS
    want = F.broadcast(few_rows(spark, wanted, pa.schema([_PATTERN, _FULL, ("want", pa.int64())])))  # one row a pattern, as below
    rows = sizes.join(want, "pattern").withColumn("b1", F.shiftright("seed", high)).withColumn("b2", F.shiftright("seed", low))
    first = _boundary(rows.groupBy("pattern", "want", "b1").agg(F.sum("size").alias("words")), "b1").collect()
    first = F.broadcast(few_rows(spark, first, pa.schema([_PATTERN, ("b1", pa.int64()), _BEFORE])))
    inside = rows.join(first, ["pattern", "b1"]).withColumn("want", F.col("want") - F.col("before")).drop("before")
    second = _boundary(inside.groupBy("pattern", "want", "b2").agg(F.sum("size").alias("words")), "b2").collect()
    second = F.broadcast(few_rows(spark, second, pa.schema([_PATTERN, ("b2", pa.int64()), _BEFORE])))
    last = inside.join(second, ["pattern", "b2"]).withColumn("want", F.col("want") - F.col("before"))
    alike = last.groupBy("pattern", "want", "seed", "size").agg(F.sum("size").alias("words"))  # rows repeated as a whole
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("seed", "size"))
    taken = alike.withColumn("upto", upto).filter(2 * F.col("upto") - F.col("words") <= 2 * F.col("want"))
    cut = taken.groupBy("pattern").agg(F.max(F.struct("seed", "size")).alias("cut")).collect()
    found = {r["pattern"]: (r["cut"]["seed"], r["cut"]["size"]) for r in cut}
    begins = {r["pattern"]: ((r["b2"] << low) - 1, 0) for r in second.collect()}
    cuts = [(i, full, *(found.get(i) or begins.get(i) or (-1, 0))) for i, full, _ in wanted]
    return F.broadcast(few_rows(spark, cuts, pa.schema([_PATTERN, _FULL, ("cut_seed", pa.int64()), ("cut_size", pa.int64())])))


def _plan(sizes: DataFrame, weights, most_repeats):
    """Patterns by number, the plan of the mix, and what to take of each pattern."""
    totals = sorted(sizes.groupBy("sources").agg(F.sum("size").alias("words")).collect(), key=lambda r: repr(r["sources"]))
    patterns = [(r["sources"], r["words"]) for r in totals]
    sources, takes = plan_mix(patterns, weights, most_repeats)
    taken = [0] * len(patterns)
    for i, _, words in takes:
        taken[i] += words
    wanted = [(i, *(divmod(taken[i], words) if words else (0, 0))) for i, (_, words) in enumerate(patterns)]
    return patterns, sources, wanted


def plan_of(docs: DataFrame, sources: Column, id_col: str, text_col: str, weights, most_repeats: int, seed: int):
    """(narrow rows, what to take of each pattern, {source: (size, target)}). The narrow rows are written once."""
    members = F.coalesce(sources, F.array().cast("array<string>"))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), members.alias("sources"), word_count(F.col(text_col)).alias("size"), seeded(seed, id_col).alias("seed")
    )
    sizes = stored(narrow, "mix-sizes")
    patterns, targets, wanted = _plan(sizes, weights, most_repeats)
    numbers = [(s, i) for i, (s, _) in enumerate(patterns)]
    numbers = F.broadcast(few_rows(sizes.sparkSession, numbers, pa.schema([("sources", pa.list_(pa.string())), _PATTERN])))
    cuts = numbers.join(seed_cuts(sizes.join(numbers, "sources"), wanted), "pattern")
    return sizes, F.broadcast(cuts), targets


def _times(size: Column, seed: Column) -> Column:
    within = (seed < F.col("cut_seed")) | ((seed == F.col("cut_seed")) & (size <= F.col("cut_size")))
    return F.col("full") + within.cast("int")


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights=WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED):
    """doc_id, sources, size, times for each document, whose ``sources`` are an array; and {source: (size, target)}."""
    sizes, cuts, targets = plan_of(docs, sources, id_col, text_col, weights, most_repeats, seed)
    rows = sizes.join(cuts, "sources")
    return rows.select("doc_id", "sources", "size", _times(F.col("size"), F.col("seed")).alias("times")), targets


def mix_by_source(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each in its one source."""
    rows, targets = mix(docs, F.array(F.col("source").cast("string")))
    schema = pa.schema([("_source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())])
    per_source = F.broadcast(few_rows(docs.sparkSession, [(s, *t) for s, t in targets.items()], schema))  # one row a source
    both = rows.join(per_source, F.col("sources")[0].eqNullSafe(F.col("_source")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it is used, those it doesn't use not at all.

    The cuts are known before the texts are read again, so no text is shuffled.
    """
    source = F.array(F.col("source").cast("string"))
    _, cuts, _ = plan_of(docs, source, "doc_id", "text", weights, most_repeats, seed)
    own = ["sources", "pattern", "full", "cut_seed", "cut_size"]
    cuts = F.broadcast(cuts.toDF(*("_mix_" + c for c in cuts.columns)).withColumnsRenamed({"_mix_" + c: c for c in own[2:]}))
    rows = docs.select(F.struct(*docs.columns).alias("_mix_row"), source.alias("_mix_of"), word_count(F.col("text")).alias("_mix_size"), seeded(seed, "doc_id").alias("_mix_seed"))
    rows = rows.join(cuts, F.col("_mix_of") == F.col("_mix_sources"))
    times = _times(F.col("_mix_size"), F.col("_mix_seed"))
    return rows.withColumn("_mix_use", F.explode(F.array_repeat(F.lit(0), times))).select("_mix_row.*")
