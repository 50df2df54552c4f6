"""Toxicity by a classifier chain of linear models.

The categories come in a fixed order. The model of each is a logistic regression on words and word beginnings and on the
probabilities of the categories before it. In training those earlier probabilities are out-of-fold: each labelled
document gets them from a model that didn't see it, as an unlabelled document would.

The chain is fitted on a bounded sample of labelled documents (``SAMPLE``, by seeded order of their ids); its features are few
numbers a document. All documents are scored in one pass without a shuffle; a document is read whole.

Cases: a null or empty text has no words and gets the probability of such a document; labels that are null or belong to no
document are not used; of several labels for one id the largest values count; without labels of both kinds for a category
its probability is the share of that category (0 if there are no labels); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import id_and_text, in_slices, seeded, tidy

# The threshold comes from the training rows unless the caller gives one; this one stands where there is nothing to learn.
THRESHOLD = 0.5
# Nothing is rejected below this probability, so that labels which teach nothing don't empty the corpus.
LEAST_THRESHOLD = 0.25
# Labelled documents the chain is fitted on, folds, features of a model, bits of the feature space.
SAMPLE = 8_000
FOLDS = 3
FEATURES = 2_000
SPACE_BITS = 18
LEAST_DOCUMENTS = 4
PREFIXES = (4, 5, 6)
SEED = 8

_WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> tuple[int, ...]:
    """Places of a word and of its beginnings in the feature space."""
    names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(n) & ((1 << SPACE_BITS) - 1) for n in names)


class _WordFeatures(dict):
    """Features of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = _features(word)
        return value


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordFeatures()
    for batch in batches:
        found = []
        for text in in_slices(batch.column(1)):
            places = set().union(*map(known.__getitem__, words_of(text)))
            found.append(np.array(sorted(places), np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "features"])


@dataclass(frozen=True)
class Linear:
    """Weights of selected features, of the earlier categories, and the constant."""

    places: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


def _sigmoid(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def select_features(documents: Sequence[np.ndarray], target: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The features whose presence tells most about the target (signed chi-square), in at least ``LEAST_DOCUMENTS``."""
    with_it, without = np.zeros(1 << SPACE_BITS), np.zeros(1 << SPACE_BITS)
    for places, y in zip(documents, target, strict=True):
        (with_it if y else without)[places] += 1
    n1, n0 = target.sum(), len(target) - target.sum()
    both = with_it + without
    share = both / len(target)
    expected = np.maximum(share * n1, 1e-9)
    spread = np.maximum(share * (1 - share) * n1 * n0 / len(target), 1e-9)
    score = np.where((both >= LEAST_DOCUMENTS) & (share < 0.9), (with_it - expected) ** 2 / spread, 0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > 6.6])  # one in a hundred by chance


def fit_linear(documents: Sequence[np.ndarray], target: np.ndarray, earlier: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> Linear:
    """Logistic regression by accelerated gradient steps with an L2 penalty."""
    share = float(target.mean()) if len(target) else 0.0
    if not 0 < share < 1:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), 30.0 if share == 1 else -30.0)
    places = select_features(documents, target)
    where = np.full(1 << SPACE_BITS, -1)
    where[places] = np.arange(len(places))
    columns = [where[d] for d in documents]
    columns = [c[c >= 0] for c in columns]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    column = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    n, m = len(target), len(places)
    weights, constant = np.zeros(m + earlier.shape[1]), float(np.log(share / (1 - share)))
    held, held_constant, speed = weights.copy(), constant, 1.0
    longest = max(1.0, float(np.mean([len(c) for c in columns])) + earlier.shape[1] + 1)
    step = 4.0 / longest
    for _ in range(rounds):
        z = held_constant + np.bincount(row, held[:m][column], n) + earlier @ held[m:]
        error = (_sigmoid(z) - target) / n
        slope = np.concatenate([np.bincount(column, error[row], m), earlier.T @ error]) + penalty * held
        new, new_constant = held - step * slope, held_constant - step * error.sum()
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        held = new + (speed - 1) / faster * (new - weights)
        held_constant = new_constant + (speed - 1) / faster * (new_constant - constant)
        weights, constant, speed = new, float(new_constant), faster
    return Linear(places, weights[:m], weights[m:], constant)


def predict(model: Linear, documents: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    weight = np.zeros(1 << SPACE_BITS)
    weight[model.places] = model.weights
    return _sigmoid(np.array([weight[d].sum() for d in documents]) + earlier @ model.earlier + model.constant)


def best_threshold(probability: np.ndarray, target: np.ndarray) -> float:
    """Where out-of-fold probabilities part the classes best (F-measure, precision counting double), midway to the next one below; 0.5 without labels."""
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(target[order])
    if not len(hits) or not 0 < hits[-1] < len(target):
        return THRESHOLD
    f = 1.25 * hits / (np.arange(1, len(hits) + 1) + 0.25 * hits[-1])
    sorted_p = probability[order]
    f[:-1][sorted_p[:-1] == sorted_p[1:]] = 0  # equal probabilities stay together
    at = int(np.argmax(f))
    return max(LEAST_THRESHOLD, float((sorted_p[at] + (sorted_p[at + 1] if at + 1 < len(sorted_p) else 0)) / 2))


def fit_chain(documents: Sequence[np.ndarray], targets: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> tuple[list[Linear], float]:
    """One model a category; later ones are trained with out-of-fold probabilities of the earlier ones.

    Also the threshold for the last category, from its own out-of-fold probabilities.
    """
    chain, earlier = [], np.zeros((len(documents), 0))
    for target in targets.T:
        chain.append(fit_linear(documents, target, earlier))
        unseen = np.zeros(len(documents))
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(rest):
                model = fit_linear([documents[i] for i in rest], target[rest], earlier[rest])
                unseen[own] = predict(model, [documents[i] for i in own], earlier[own])
        earlier = np.column_stack([earlier, unseen])
    return chain, best_threshold(earlier[:, -1], targets[:, -1])


class Scorer:
    """Probabilities of all categories for the words of a text."""

    def __init__(self, chain: Sequence[Linear], threshold: float = THRESHOLD):
        self.chain, self.threshold = chain, threshold
        used = np.unique(np.concatenate([m.places for m in chain])) if chain else np.zeros(0, np.int64)
        self._weights = {int(p): [0.0] * len(chain) for p in used}
        for k, model in enumerate(chain):
            for p, w in zip(model.places, model.weights, strict=True):
                self._weights[int(p)][k] = float(w)
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def score(self, text: str | None) -> list[float]:
        known, met, weights = self._known, set(), self._weights
        if len(known) > 100_000:
            known.clear()
        for word in words_of(text):
            places = known.get(word)
            if places is None:
                places = known[word] = tuple(p for p in _features(word) if p in weights)
            if places:
                met.update(places)
        sums = np.sum([weights[p] for p in met], axis=0) if met else np.zeros(len(self.chain))
        out: list[float] = []
        for model, own in zip(self.chain, sums, strict=True):
            out.append(round(float(_sigmoid(own + model.constant + (np.dot(model.earlier, out) if out else 0.0))), 6))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = SEED) -> Scorer:
    """Fit the chain. ``categories``: name and 0/1 column over ``labels``, in the order of the chain.

    At most ``sample`` labelled documents come to the driver, as feature numbers below 2**18.
    """
    names = [f"_c{k}" for k in range(len(categories))]
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), *(c.cast("int").alias(n) for n, c in zip(names, categories.values(), strict=True))).dropna()
    marks = marks.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names)).withColumn("_order", seeded(seed, "doc_id"))
    few = F.broadcast(marks.orderBy("_order", "doc_id").limit(sample))  # at most ``sample`` short rows
    texts = id_and_text(docs, id_col, text_col).join(few, "doc_id", "left_semi")
    features = texts.mapInArrow(_feature_batches, "doc_id bigint, features binary")
    rows = features.join(few, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), *(F.first(n).alias(n) for n in names), F.first("_order").alias("_order"))
    found = sorted(rows.collect(), key=lambda r: (r["_order"], r["doc_id"]))
    documents = [np.frombuffer(r["features"], np.uint32).astype(np.int64) for r in found]
    targets = np.array([[r[n] for n in names] for r in found], float).reshape(len(found), len(names))
    fold = np.array([r["_order"] % FOLDS for r in found], np.int64)
    return Scorer(*fit_chain(documents, targets, fold))


def _score_batches(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(t) for t in in_slices(batch.column(1))]
            columns = [pa.array([s[k] for s in scores], pa.float64()) for k in range(len(scorer.chain))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f"p{k}" for k in range(len(columns)))])

    return run


def labelled_categories() -> dict[str, Column]:
    """Low quality first: junk that only looks abusive is told from abuse by its probability."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic of every document."""
    categories = labelled_categories()
    scorer = train(docs, labels, categories)
    schema = "doc_id bigint, " + ", ".join(f"p{k} double" for k in range(len(categories)))
    scored = id_and_text(docs).mapInArrow(tidy(_score_batches(scorer)), schema)
    named = scored.toDF("doc_id", *("p_" + c for c in categories))
    return named.withColumn("toxic", F.col("p_toxic") >= (scorer.threshold if threshold is None else threshold))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    scorer = train(docs, labels, labelled_categories())
    last, limit = len(scorer.chain) - 1, scorer.threshold if threshold is None else threshold

    @F.arrow_udf("double")
    def p_toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda some: (pa.array([scorer.score(t)[last] for t in in_slices(texts)], pa.float64()) for texts in some))(batches)

    return docs.filter(p_toxic(F.col("text").cast("string")) < limit)
