"""Native text functions: tokens, sentiment, keyword rules, sentences."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.columns import col, contains_any

LETTERS = r"[^\p{L}\p{M}]+"  # splits lower-cased text into words without digits
WORDS = r"[^\p{L}\p{M}\p{N}]+"  # splits lower-cased text into words of any script
# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("Rs", "Mr", "Mrs", "Ms", "Dr", "No", "St", "vs")
# A sentence ends at a line end, and after . ! ? or a danda before white space.
_END = ".!?\u0964"
# What comes next is looked at first; it rules out most places.
SENTENCE_END = rf"(?=\s)(?:\n|(?<=[{_END}])(?<!\b(?:{'|'.join(ABBREVIATIONS)})\.))"


@dataclass(frozen=True)
class Rule:
    """``label`` applies when a word of ``any_of`` occurs or the score lies below ``score_below``."""

    label: str
    any_of: tuple[str, ...] = ()
    score_below: float | None = None


@dataclass(frozen=True)
class TextRules:
    """Word lists and rules behind the enrichment; replace any of them for another domain."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    competitors: tuple[str, ...]
    cancel_words: tuple[str, ...] = ("cancel",)
    intents: tuple[Rule, ...] = ()
    signals: tuple[Rule, ...] = ()
    default_intent: str = "general"
    default_signal: str = "none"
    override_signal: str = "cancellation_intent"
    competitor_signal: str | None = "competitor_mention"
    signal_words: tuple[str, ...] = field(default=())

    @property
    def markers(self) -> tuple[str, ...]:
        """Words that make a sentence worth quoting."""
        return self.signal_words or tuple(dict.fromkeys(self.positive + self.negative))

    @property
    def lexicon(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.positive + self.negative + self.markers))


# Our own English word lists for motor-insurance conversations.
INSURANCE_RULES = TextRules(
    positive=(
        "thank", "thanks", "great", "good", "happy", "excellent", "helpful", "satisfied", "smooth",
        "quick", "appreciate", "pleased", "perfect", "wonderful", "easy", "resolved",
    ),
    negative=(
        "bad", "unhappy", "angry", "delay", "delayed", "worst", "terrible", "frustrated", "disappointed",
        "pathetic", "rejected", "complaint", "unacceptable", "cancel", "waiting", "expensive", "poor",
    ),
    competitors=(
        "HDFC Ergo", "Bajaj Allianz", "ICICI Lombard", "Tata AIG", "Acko", "Digit", "New India Assurance",
        "Reliance General", "SBI General", "Royal Sundaram",
    ),
    intents=(
        Rule("cancellation", any_of=("want to cancel", "cancel my policy", "please cancel")),
        Rule("complaint", score_below=-0.2),
        Rule("claim_enquiry", any_of=("claim",)),
        Rule("renewal", any_of=("renew",)),
        Rule("payment", any_of=("payment", "premium due", "installment")),
        Rule("feedback", any_of=("feedback", "thank")),
    ),
    signals=(
        Rule("cancellation_intent", any_of=("cancel",)),
        Rule("claim_delay", any_of=("claim is pending", "claim has been pending", "claim delay")),
        Rule("price_shock", any_of=("premium increase", "too expensive", "price hike")),
        Rule("missed_payment", any_of=("missed payment", "overdue", "payment failed")),
    ),
)


def tokens(text: str | Column, pattern: str = LETTERS) -> Column:
    """Words of the lower-cased text."""
    return F.array_remove(F.split(F.lower(col(text)), pattern), "")


def only(words: Column, lexicon: Sequence[str]) -> Column:
    """The elements of a word array that belong to the lexicon."""
    return F.filter(words, lambda w: w.isin(*lexicon))


def lexicon_words(lowered: Column, lexicon: Sequence[str]) -> Column:
    """The same as splitting lower-cased text at ``LETTERS`` and keeping what belongs to the lexicon, without an object for every word."""
    words = [w for w in lexicon if w and all(unicodedata.category(c)[0] in "LM" for c in w)]
    if not words:
        return F.array().cast("array<string>")
    letter = r"\p{L}\p{M}"
    first = "".join(sorted({w[0] for w in words}))
    # A letter beyond the basic plane makes the look behind step over whole characters.
    far = "\U00010000"
    whole = rf"(?=[{first}])(?<![{letter}{far}])(?:{'|'.join(words)})(?![{letter}])"
    return F.regexp_extract_all(lowered, F.lit(whole), F.lit(0))


def hits(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(only(words, lexicon)) if lexicon else F.lit(0)


def balance(positive: Column, negative: Column) -> Column:
    """(pos - neg) / (pos + neg) at six places, 0 when nothing was found."""
    total = positive + negative
    return F.when(total > 0, F.round((positive - negative) / total, 6)).otherwise(F.lit(0.0))


def sentiment_score(words: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Lexicon sentiment in [-1, 1] of a word array."""
    return balance(hits(words, positive), hits(words, negative))


def sentiment_label(score: str | Column, threshold: float = 0.2) -> Column:
    c = col(score)
    return F.when(c >= threshold, "positive").when(c <= -threshold, "negative").otherwise("neutral")


def apply_rules(rules: Sequence[Rule], lowered: Column, score: Column, default: str) -> Column:
    """Label of the first rule that applies."""
    out = None
    for rule in rules:
        cond = contains_any(lowered, rule.any_of) if rule.any_of else F.lit(False)
        if rule.score_below is not None:
            cond = cond | (score < rule.score_below)
        out = F.when(cond, F.lit(rule.label)) if out is None else out.when(cond, F.lit(rule.label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def first_mention(lowered: Column, names: Sequence[str]) -> Column:
    """The name that occurs first as a whole word; at one position the longer name wins. NULL if none.

    One search for all names, longer ones first; the texts without any are ruled out by the plain search.
    """
    if not names:
        return F.lit(None).cast("string")
    edge = r"[\p{L}\p{M}\p{N}]"
    by_form = {}
    for name in sorted(names, key=lambda n: (-len(n), n)):
        by_form.setdefault(name.lower(), name)
    whole = "|".join(rf"\Q{form}\E(?<!{edge}\Q{form}\E)(?!{edge})" for form in by_form)
    form = F.when(contains_any(lowered, tuple(by_form)), F.regexp_extract(lowered, whole, 0))
    named = F.create_map(*[F.lit(x) for pair in by_form.items() for x in pair])
    return F.try_element_at(named, form)


def override_signal(signal: Column, lowered: Column, words: Sequence[str], label: str) -> Column:
    """Any mention of a cancellation word turns the signal into ``label``."""
    return F.when(contains_any(lowered, words), F.lit(label)).otherwise(signal)


def sentences(text: str | Column) -> Column:
    """Trimmed sentences in reading order, those without any word or other sign left out."""
    found = F.transform(F.split(col(text), SENTENCE_END), lambda s: F.trim(s))
    return F.filter(found, lambda s: s.rlike(rf"[^{_END}\s]"))


def marked_sentences(text: str | Column, lexicon: Sequence[str]) -> Column:
    """Array of (at, sentence, words of the lexicon in it). The text is searched for words once, here."""

    def mark(sentence, at):
        found = lexicon_words(F.lower(sentence), lexicon)
        return F.struct(at.alias("at"), sentence.alias("sentence"), found.alias("found"))

    return F.transform(sentences(text), mark)


def found_words(marked: Column) -> Column:
    """All lexicon words of the text."""
    return F.flatten(F.transform(marked, lambda m: m["found"]))


def ranked_sentences(marked: Column, markers: Sequence[str]) -> Column:
    """Array of (rank, at, sentence), most marker words first, earlier first among equals."""

    def scored(m):
        return F.struct((-hits(m["found"], markers)).alias("rank"), m["at"].alias("at"), m["sentence"].alias("sentence"))

    return F.sort_array(F.transform(marked, scored))


def summary_of(ranked: Column, best: int = 2) -> Column:
    """The ``best`` top-ranked sentences put back in reading order; NULL for text without sentences."""
    chosen = F.slice(ranked, 1, best)
    ordered = F.array_sort(F.transform(chosen, lambda s: F.struct(s["at"].alias("at"), s["sentence"].alias("sentence"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ")
    return F.when(F.size(ranked) > 0, joined)


def key_quote_of(ranked: Column) -> Column:
    """The top-ranked sentence, verbatim and whole."""
    return F.try_element_at(ranked, F.lit(1))["sentence"]
