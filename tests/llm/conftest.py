from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
# Extra columns with the names that the operators use themselves.
EXTRA = ("node", "key", "kept", "size", "seed", "n", "h", "digest", "pattern", "times", "words", "spans", "label", "component_id", "text_sha256")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def doc_row(doc_id, text, source="src0"):
    return (doc_id, text, None, source, None, *("x" for _ in EXTRA))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): null ids and texts, empty and white texts, a very long one, copies, near copies, repeated rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choices(vocabulary, k=60_000))
    base = rng.choices(vocabulary, k=120)
    rows = [(None, "no id at all", "a"), (None, None, None), (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, "One", "b"), (5, "one", "b")]
    rows += [(6, "one two", "b"), (7, long, "c"), (8, long + " end", "c"), (9, "Ab\u00a0cd\u2003ef É é", "c"), (10, "x" * 200_000, "c")]
    for i in range(40):  # near copies: some words changed in each
        words = list(base)
        for k in range(i % 9):
            words[(i * 37 + k * 11) % 120] = f"new{i}-{k}"
        rows.append((100 + i, " ".join(words), "d"))
    rows += [(200 + i, " ".join(base).upper(), "d") for i in range(25)]  # copies
    # Near copies without an id: one beside the others, one that alone links two rows, and two by themselves.
    other, lone = rng.choices(vocabulary, k=100), rng.choices(vocabulary, k=100)
    rows += [(None, " ".join([*base[:-1], "odd"]), "d"), (None, " ".join(lone), None), (None, " ".join([*lone[:-1], "odd"]), None)]
    rows += [(500, " ".join(["x0", "x1", *other[2:]]), "d"), (None, " ".join(other), "d"), (501, " ".join([*other[:-2], "y0", "y1"]), "d")]
    rows += [(300, "same row " * 20, "e")] * 4
    shared = " ".join(rng.choices(vocabulary, k=40))
    rows += [(400 + i, " ".join([*rng.choices(vocabulary, k=30 + i), shared, *rng.choices(vocabulary, k=20)]), None) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([doc_row(*r) for r in edge_rows], DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def real_rows(real_docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in real_docs.collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")
