"""URL filters: rules indexed by their rarest literal token.

Each rule is a regular expression with literal tokens every fitting URL must hold. A rule is filed under the one that is
rarest among all URLs (counted by Spark, one row for each token of a rule). The tokens of a URL fetch the
candidate rules, and only those run their expression.

Two kinds of rules: host rules (host and path prefix, the longest fitting one decides) and, where none fits, block
patterns; a URL that fits nothing is allowed.

Cases: a null URL or one without ``://`` has an empty host and path and is allowed without a rule; of rules of one length one that
blocks wins, then the last by name; a rule without any token is tried on every URL; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains, if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def expression(self) -> str:
        return rf"(?s)(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}.*"

    @property
    def tokens(self) -> list[str]:
        """Tokens of the host, and those of the path that end within the rule."""
        inner = re.sub(r"[A-Za-z0-9]+\Z", "", self.path)
        return _TOKEN.findall(self.host) + _TOKEN.findall(inner.translate(_UPPER))


@dataclass(frozen=True)
class BlockPattern:
    """A regular expression for host and path, lower case; ``literals`` are tokens that each fitting URL holds."""

    expression: str
    literals: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.expression

    @property
    def tokens(self) -> list[str]:
        return list(self.literals)


# The host rules of the registered query.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
# Hosts that advertise unwanted content in one of their labels.
BLOCK_PATTERNS = (
    BlockPattern(r"(?:[^/]*[.-])?adult(?:[.-][^/]*)?/.*", ("adult",)),
    BlockPattern(r"(?:[^/]*[.-])?casino(?:[.-][^/]*)?/.*", ("casino",)),
    BlockPattern(r"(?:[^/]*[.-])?bets(?:[.-][^/]*)?/.*", ("bets",)),
    BlockPattern(r"(?:[^/]*[.-])?cheap-pills(?:[.-][^/]*)?/.*", ("cheap", "pills")),
    BlockPattern(r"(?:[^/]*[.-])?ads-track(?:[.-][^/]*)?/.*", ("ads", "track")),
    BlockPattern(r"(?:[^/]*[.-])?spam(?:[.-][^/]*)?/.*", ("spam",)),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class RuleIndex:
    """Rules under their rarest token; ``frequency`` counts URLs by token (missing: none seen)."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[BlockPattern], frequency: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for rule in (*hosts, *patterns):
            entry = (rule, re.compile(rule.expression))
            tokens = sorted(set(rule.tokens), key=lambda t: (frequency.get(t, 0), t))
            (self.by_token[tokens[0]] if tokens else self.always).append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule or null, verdict)."""
        if not host and not path:
            return None, "allow"
        whole = host + path
        low = whole.translate(_UPPER)
        fitting, blocked = [], False
        index = self.by_token
        for token in {*_TOKEN.findall(low)} & index.keys():
            for rule, expression in index[token]:
                if isinstance(rule, HostRule):
                    if expression.fullmatch(whole):
                        fitting.append((len(rule.name), rule.verdict == "block", rule.name, rule))
                else:
                    blocked = blocked or bool(expression.fullmatch(low))
        for rule, expression in self.always:
            if isinstance(rule, HostRule):
                if expression.fullmatch(whole):
                    fitting.append((len(rule.name), rule.verdict == "block", rule.name, rule))
            else:
                blocked = blocked or bool(expression.fullmatch(low))
        if fitting:
            best = max(fitting, key=lambda x: x[:3])[3]
            return best.name, best.verdict
        return None, "block" if blocked else "allow"


def token_frequency(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """URLs that hold each of the given tokens; one counter a token, so no row leaves its task."""
    if not tokens:
        return {}
    low = F.lower(F.coalesce("url", F.lit("")))
    held = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    known = F.explode(F.array_intersect(held, F.array(*map(F.lit, tokens)))).alias("token")
    return {r["token"]: r["count"] for r in urls.select(known).groupBy("token").count().collect()}


def _judge_batches(index: RuleIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [index.judge(*p) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"]
            )

    return run


def judge_urls(
    pages: DataFrame, hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[BlockPattern] = BLOCK_PATTERNS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    urls = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    tokens = sorted({t for r in (*hosts, *patterns) for t in r.tokens})
    index = RuleIndex(hosts, patterns, token_frequency(urls, tokens))
    return urls.mapInArrow(_judge_batches(index), "page_id bigint, host string, path string, rule string, verdict string")
