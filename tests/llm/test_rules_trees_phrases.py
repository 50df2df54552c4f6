"""Quality rules, Merkle manifest and collocations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import collocations as phrases
from holdfast.llm.collocations import collocations
from holdfast.llm.double_array import DoubleArray
from holdfast.llm.merkle import Block, ancestors, manifest, siblings_of, tampered_versions
from holdfast.llm.quality_rules import Rule, certified_cutoffs, features, judged_documents, tail_probability

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules


def measured(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_features(edge_docs, edge_rows):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter(tuple(r) for r in features(edge_docs).select(columns).collect())
    assert got == Counter((i, *measured(t)) for i, t, _ in edge_rows)


def test_features_of_lines_symbols_and_overlaps(spark):
    texts = ["a b\na b\n \n\na b \nc", "#*$%&|<> x#", "a " * 30, "w0 w1 w2 w3 w4 w5 w6 w7 " * 2 + "z", "\U0001f600 é x " * 9, "\n\n", "x\r\nx\r\nx"]
    rng = random.Random(1)
    texts += [" ".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r[0]: tuple(r[1:]) for r in features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_tail_probability(spark):
    cases = [(n, k, p) for n in (1, 10, 200, 1500) for k in (0, 1, 7, 90) if k <= n for p in (0.01, 0.2)]
    for n, k, p in cases:
        got = spark.range(1).select(tail_probability(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p).alias("x")).first()["x"]
        assert got == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def table(spark, rows):
    """(stratum, symbols in a text of 100 words, good) to measured rows and labels."""
    docs = [(i, s, 100, 500, x, 1, 0, 0, False) for i, (s, x, _) in enumerate(rows)]
    columns = "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
    return spark.createDataFrame(docs, columns), spark.createDataFrame([(i, g) for i, (_, _, g) in enumerate(rows)], "doc_id bigint, quality int")


RULE = Rule("symbols", "1000 * n_symbols div n_words", (900, 700, 500, 300, 100, 50))


def test_cutoffs_are_certified_by_stratum(spark):
    # In "a" good documents have up to 2 symbols, some of "b" up to 60; junk has 40 everywhere; "c" has few labels.
    rows = [("a", i % 3, 1) for i in range(600)] + [("a", 40, 0)] * 50
    rows += [("b", 60 if i % 5 == 0 else 1, 1) for i in range(600)] + [("b", 40, 0)] * 50
    rows += [("c", 0, 1)] * 20 + [("c", 40, 0)] * 20 + [(None, 0, 1)] * 400 + [(None, 40, 0)] * 9
    strata, cutoffs = certified_cutoffs(*table(spark, rows), rules=[RULE], limit=0.05)
    assert {r["bin"] for r in strata.collect()} == {"=a", "=b", "=c", "null"}
    # 20 % of "b" is lost from 500 on, and cutoffs above catch nothing; 20 labels certify nothing at 5 %.
    assert {(r["bin"], r["cutoff"], r["n_good"], r["false"], r["caught"]) for r in cutoffs.collect()} == {("=a", 300, 600, 0, 50), ("null", 300, 400, 0, 9)}


def test_false_rejections_stay_below_the_limit(spark):
    rng = random.Random(3)
    for share in (0.04, 0.06):  # 30 samples from a population that loses this share at the only cutoff
        lost = 0
        rows = [(f"s{k}", 50 if rng.random() < share else 0, 1) for k in range(30) for _ in range(400)]
        rows += [(f"s{k}", 50, 0) for k in range(30) for _ in range(500)]
        _, cutoffs = certified_cutoffs(*table(spark, rows), rules=[Rule("symbols", RULE.value, (100,))], limit=0.05, price=1)
        lost = cutoffs.count()
        assert lost == 0  # 400 draws can't show that 4 % lies below 5 % at a level of 0.05 / 30


def test_judged(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 997}" for k in range(40)), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(f"word{(i * 5 + k) % 991} |" for k in range(30)), "en") for i in range(60)]
    short = [(2000, "too few", "en"), (2001, None, "en"), (2002, "", None), (None, good[0][1], "en")]
    docs = spark.createDataFrame([(*r, "x") for r in good + junk + short], "doc_id bigint, text string, lang string, bin string")
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(20)] + [(None, 1)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in judged_documents(docs, labels).collect()}
    assert all(kept[i] for i in range(900)) and kept[None] and not any(kept[1000 + i] for i in range(60))
    assert not (kept[2000] or kept[2001] or kept[2002])
    nothing = judged_documents(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in nothing) and len(nothing) == docs.count()
    assert judged_documents(docs.limit(0), labels).count() == 0


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = ""
    for nodes in levels[:-1]:
        first = at - at % 8
        out += "".join(nodes[first:at] + nodes[at + 1 : first + 8])
        at //= 8
    return out


def expected_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""

    def leaf(row, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def lowered(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: climb([n for _, n, _ in sorted(trees[x], key=lambda y: y[:2])]) for x in order}
    top = climb([levels[x][-1][0] for x in order])
    out = []
    for place, lang in enumerate(order):
        for at, (_, mine, r) in enumerate(sorted(trees[lang], key=lambda y: y[:2])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            bottom = [*levels[lang][0]]
            bottom[at] = leaf(r, lowered(r[4])) if changed else mine
            subroots = [levels[x][-1][0] for x in order]
            subroots[place] = climb(bottom)[-1][0]
            folded = climb(subroots)[-1][0]
            proof = sha(siblings(levels[lang], at) + siblings(top, place))
            out.append((r[0], mine, levels[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, pos string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "": 2, "é": 70}, {"en": 700, "fr": 512, "zz": 513, None: 65}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(5 * n), rng.choice(["a", None, "ü"]), lang, rng.choice([None, 7]), rng.choice(["Text É", "same", None, "", "Long " * 50])))
    rows[0] = (None, *rows[0][1:])
    rows += rows[:2]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(3)
    got = Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest(docs).collect())
    assert got == expected_manifest(rows)


def test_manifest_of_many_langs_and_none(spark):
    rows = [(i, "s", f"lang{i % 600:03}", i, f"Text {i}") for i in range(700)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest(docs).collect())
    assert got == expected_manifest(rows)
    assert manifest(docs.limit(0)).count() == 0


def test_versions_copy_ancestors_only(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}", "", "") for i in range(600)], DOCS)
    result = {r["doc_id"]: r for r in manifest(docs).collect()}
    versions = tampered_versions(docs).collect()
    assert {r["doc_id"] for r in versions} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 0}
    for r in versions:
        assert len(r["copied"]) == 5  # leaf, three levels of the block, root of two blocks
        assert r["copied"][-1] == result[r["doc_id"]]["folded_root"] and r["copied"][0] != result[r["doc_id"]]["leaf"]


def test_a_version_shares_what_it_does_not_copy():
    leaves = [bytes([i]) * 32 for i in range(100)]
    block = Block(leaves, 3)
    before = [[*x] for x in block.levels]
    version = block.version(37, b"x" * 32)
    assert block.levels == before
    assert sorted(version.copied) == [(0, 37), (1, 4), (2, 0), (3, 0)]
    assert version.node(0, 36) is block.levels[0][36] and version.node(1, 5) is block.levels[1][5]
    assert ancestors(b"x" * 32, block.path(37))[-1] == version.root and ancestors(leaves[37], block.path(37))[-1] == block.root
    assert len(siblings_of(block.path(37))) == 32 * (7 + 7 + 1)


# Collocations


def expected_phrases(rows, top=2_000, least=10, longest=3):
    """rows: (lang, text)"""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                inside |= {p[i : i + size] for i in range(len(p) - size + 1) if 100 * a >= 50 * f[p[i : i + size]]}
        rows = []
        for p, a in frequent.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found_phrases(docs, **how):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in collocations(docs, **how).collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(9)
    words = ["the", "The", "of", "a", "b", "c", "New", "york", "é", "İx", "w\x1cw", "1|2"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ", ", ".", "!\n", ";x:", "\r\n", " "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    rows += [("en", None), ("en", ""), (None, "..."), ("xx", "once only")] + [("la", "ab ab ab ab")] * 6 + [("lb", "stop word " * 40_000)]
    return rows


@pytest.mark.parametrize("tries", [(1 << 16, 32), (7, 2)])
def test_collocations(spark, phrase_rows, tries, monkeypatch):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", tries[0])
    monkeypatch.setattr(phrases, "TRIES_A_PASS", tries[1])
    docs = spark.createDataFrame([(i, lang, t, "x", "y", 1) for i, (lang, t) in enumerate(phrase_rows)], "doc_id bigint, lang string, text string, phrase string, key string, f bigint")
    assert found_phrases(docs.repartition(4)) == expected_phrases(phrase_rows)
    assert found_phrases(docs, top=3, longest=2) == expected_phrases(phrase_rows, top=3, longest=2)


@pytest.mark.parametrize("share", [1, 1000])
def test_candidates_of_some_files_come_first(spark, phrase_rows, share, monkeypatch):
    monkeypatch.setattr(phrases, "FIRST_SHARE", share)
    sent = []
    monkeypatch.setattr(phrases, "_once", lambda rows, length, once=phrases._once: sent.append((length, rows.count())) or once(rows, length))
    docs = spark.createDataFrame([(lang, t) for lang, t in phrase_rows], "lang string, text string").repartition(12)
    assert found_phrases(docs) == expected_phrases(phrase_rows)
    rounds = [n for length, n in sent if length == 2]
    # Of twelve files each candidate comes from few: rounds of 1, 1, 2, 4 and 4 files, or one file and what it lacks.
    assert len(rounds) in ((5, 6) if share == 1 else (1, 2)) and rounds[0] > sum(rounds[2:5]) * (share == 1)


def test_longer_collocations_and_none(spark, phrase_rows):
    docs = spark.createDataFrame([(lang, t) for lang, t in phrase_rows], "lang string, text string")
    assert found_phrases(docs, longest=5, least=4) == expected_phrases(phrase_rows, longest=5, least=4)
    assert found_phrases(docs.limit(0)) == [] and found_phrases(docs, least=10**7) == []


def test_shared_symbols_are_found_and_done_again(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choices([f"w{k}" for k in range(40)], k=200))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    first = docs.mapInArrow(phrases._encode(0, 10), phrases._ENCODED).filter("word is not null").select("word", "symbol").distinct().collect()
    assert len({r["symbol"] for r in first}) < len({r["word"] for r in first}) == 40  # the first seed won't do
    assert found_phrases(docs, bits=10) == expected_phrases(rows)


def test_double_array():
    rng = np.random.default_rng(0)
    for count, size, length in ((1, 3, 2), (200, 12, 2), (4_000, 60, 3), (2_000, 2_000, 1)):
        symbols = rng.integers(1, 1 << 63, size).astype(np.uint64)
        rows = np.unique(symbols[np.minimum((rng.pareto(0.7, (count, length)) * 2).astype(int), size - 1)], axis=0)
        text = symbols[np.minimum((rng.pareto(0.7, 20_000) * 2).astype(int), size - 1)]
        at = np.arange(len(text) - length + 1)
        got = np.bincount(DoubleArray.of(rows).accepted(text, at), minlength=len(rows))
        met = Counter(zip(*(text[k : len(at) + k].tolist() for k in range(length)), strict=True))
        assert got.tolist() == [met[tuple(r)] for r in rows.tolist()]
