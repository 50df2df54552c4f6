"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, plus signs, schemes and words that announce an
identifier. From each place a local parser, linear in what it reads, expands and validates the boundaries. Digit
runs, which announce themselves, are found by one scan.

Base spans (email, ip, card, phone) are exactly the valid leftmost matches of their patterns. The method adds cards and
phones that stand beside other numbers, where the pattern takes both together and fails, and three more kinds:
``url`` (scheme to the end of the address), ``account`` (identifier after a cue word) and ``secret`` (value after a cue and
``=``, or a key with a known prefix). Kinds overlap freely, spans within a kind don't. Values end with their class of characters
or their closing quote and have no greatest length. A secret has 8 characters or more; unquoted ones below 16 need a digit or ``=`` right before them.

Cases: a null or empty text has no spans; offsets are code points, ends exclusive; a text of any length takes linear time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import id_and_text, in_slices

# The kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "secret")
# Schemes of addresses, and words that announce an identifier or a secret.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "passport", "ssn", "social security", "card number", "customer id", "tax id")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api key", "apikey")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([ ().0-9-]++)")
_GROUP = re.compile(r"[0-9]+")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}+")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ACCOUNT = re.compile(
    r"(?: ?(?i:no|number|nr|id))?[.:#]{0,2}[ ]{0,2}"
    r"([A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9]){5,33}+[A-Za-z0-9]*+(?:[ -](?=[A-Za-z]*+[0-9])[A-Za-z0-9]++)*+)"
)
_VALUE = r"[A-Za-z0-9_./+=-]"
_SECRET = re.compile(
    r"[ ]{0,2}[=:][ ]{0,2}(?:\"([^\"\s]{8,}+)\"|'([^'\s]{8,}+)'"
    rf"|({_VALUE}{{16,}}+)|((?=[A-Za-z_./+=-]*+[0-9]){_VALUE}{{8,}}+)|(?<==)({_VALUE}{{8,}}+))"
)


@functools.lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    for prefix in KEY_PREFIXES:
        found.add_word(prefix, ("key", len(prefix)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        twice = 2 * int(d)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> Span | None:
    """Around an at-sign: left over local characters but not before ``after``, right over a domain."""
    domain = _DOMAIN.match(text, at + 1)
    if not domain:
        return None
    begin = at
    while begin > after and text[begin - 1] in _LOCAL:
        begin -= 1
    return (begin, domain.end()) if begin < at else None


def _ips(text: str) -> list[Span]:
    """Chains of numbers joined by dots, four by four: a greedy pattern takes the first four, then begins behind them."""
    out = []
    for chain in _NUMBERS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        numbers, at = chain[0].split("."), chain.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((at, end))
            at = end + 1
    return out


def _small(number: str) -> bool:
    """At most 255, for numbers of any length."""
    short = number.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _cards(text: str) -> tuple[list[Span], list[Span]]:
    """(base, added): whole runs that are valid, and valid groups within runs that are not."""
    base, added = [], []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                base.append(m.span())
            else:
                added += _grouped_cards(text, *m.span())
    return base, added


def _grouped_cards(text: str, begin: int, end: int) -> list[Span]:
    """Card numbers among the groups of a run that also holds other numbers: whole groups of four digits or more."""
    groups, out, i = [g.span() for g in _GROUP.finditer(text, begin, end)], [], 0
    while i < len(groups):
        digits, j, found = "", i, 0
        while j < len(groups) and 4 <= groups[j][1] - groups[j][0] <= 19 and len(digits) < 16:
            digits += text[groups[j][0] : groups[j][1]]
            j += 1
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found = j
        if found:
            out.append((groups[i][0], groups[found - 1][1]))
        i = found or i + 1
    return out


def _phone(text: str, at: int) -> tuple[Span | None, bool, int]:
    """(span, whether it is a base one, where the base match ends) at a plus sign.

    The base match goes from the first digit to the last one of the run. If it has too many digits, the
    longest row of whole groups that has not is added instead.
    """
    m = _PHONE.match(text, at)
    if not m:
        return None, False, at
    run = m[1]
    kept = len(run.rstrip(" ().-"))
    if kept < 2:  # a character between the first and the last digit is needed
        return None, False, at
    end = m.start(1) + kept
    digits, last = 0, None
    for group in _GROUP.finditer(text, at, end):
        digits += group.end() - group.start()
        if digits > 15:
            return ((at, last) if last else None), False, end
        last = group.end() if digits >= 8 else None
    return ((at, end) if digits >= 8 else None), True, end


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base, added) spans by kind, in order."""
    spans: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    more: dict[str, list[Span]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    done = dict.fromkeys(more, 0)
    for last, (kind, length) in _anchors().iter(text):
        begin = last - length + 1
        if kind == "@":
            if begin >= done["email"] and (span := _email(text, begin, done["email"])):
                spans["email"].append(span)
                done["email"] = span[1]
        elif kind == "+":
            if begin >= done["phone"]:
                span, is_base, end = _phone(text, begin)
                done["phone"] = max(done["phone"], end)
                if span:
                    (spans if is_base else more)["phone"].append(span)
        elif begin >= done["secret" if kind == "key" else kind] and (begin == 0 or not text[begin - 1].isalnum()):
            if kind == "key":
                m = _KEY.match(text, begin)
                span = m.span() if m else None
                kind = "secret"
            elif kind == "url":
                m = _ADDRESS.match(text, last + 1)
                span = (begin, m.start() + len(m[0].rstrip(".,;:!?)]"))) if m else None
                span = span if span and span[1] > last + 1 else None
            else:
                m = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
                span = m.span(m.lastindex) if m else None
            if span:
                more[kind].append(span)
                done[kind] = span[1]
    if any(map(text.__contains__, "0123456789")):
        spans["ip"] = _ips(text)
        spans["card"], more["card"] = _cards(text)
    return spans, more


def _listed(*found: dict[str, list[Span]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in (*BASE_KINDS, *ADDED_KINDS) for a, b in sorted(s for x in found for s in x.get(k, ()))])


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in in_slices(batch.column(1)):
            base, more = find_spans(text or "")
            digest = hashlib.sha256(_listed(base).encode()).hexdigest()
            rows.append((*(len(base[k]) for k in BASE_KINDS), digest, _listed(base, more)))
        columns = [*zip(*rows, strict=True)] if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", *("n_" + k for k in BASE_KINDS), "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return id_and_text(docs, id_col, text_col).mapInArrow(_span_batches, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def masked(text: str | None) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then longest, names it."""
    text = text or ""
    found = sorted((a, -b, k) for by_kind in find_spans(text) for k, spans in by_kind.items() for a, b in spans)
    out, at = [], 0
    for begin, end, kind in found:
        if begin >= at:
            out += [text[at:begin], f"<{kind}>"]
            at = -end
        elif -end > at:
            at = -end
    return "".join([*out, text[at:]])
