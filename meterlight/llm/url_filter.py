"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map

# The host and path rules every run applies, (verdict, host, path).
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Pattern rules for urls that no host rule fits, over the lower-cased host, path and query: a
#: url that one of them matches is blocked. Beside each pattern stands, for every branch of it,
#: the whole tokens a match contains; the rarest of them leads to the rule.
PATTERNS = (
    (r"(^|\.)ads?\.", (("ad",), ("ads",))),
    (r"/(banner|popup|sponsored)/", (("banner",), ("popup",), ("sponsored",))),
    (r"(^|[./-])(casino|poker|betting)([./-]|$)", (("casino",), ("poker",), ("betting",))),
    (r"(^|[./-])(porn|xxx|adult)([./-]|$)", (("porn",), ("xxx",), ("adult",))),
    (r"/(login|signin|signup|checkout|cart)([/.?]|$)", (("login",), ("signin",), ("signup",), ("checkout",), ("cart",))),
    (r"/wp-(admin|login|json)([/.?]|$)", (("wp", "admin"), ("wp", "login"), ("wp", "json"))),
    (r"[?&]utm_source=(spam|affiliate)(&|#|$)", (("utm", "source", "spam"), ("utm", "source", "affiliate"))),
    (r"\.(exe|apk|zip|rar|iso)([?#]|$)", (("exe",), ("apk",), ("zip",), ("rar",), ("iso",))),
    (r"(^|\.)(tracker|doubleclick|pixel)\.", (("tracker",), ("doubleclick",), ("pixel",))),
)

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules are configuration that every task holds; more than this many characters raise an error.
MAX_RULE_CHARS = 64 << 20


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest) by the text of the url; all empty without ``://``."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path, *query = re.split(r"[?#]", rest[len(host) :], maxsplit=1)
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path, rest[len(host) + len(path) :]


def host_patterns() -> list[tuple[str, str, str]]:
    """The host rules as (name, verdict, pattern) over ``host + path``: a host and its subdomains."""
    return [(h + p, v, rf"^(?:[^/]*\.)?{re.escape(h)}{re.escape(p)}") for v, h, p in HOST_RULES]


class RuleIndex:
    """Rules by the rarest token a match of them must contain."""

    def __init__(self, frequency: dict[str, int], hosts=None, patterns=PATTERNS) -> None:
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        hosts = host_patterns() if hosts is None else hosts
        self.hosts, self.rules = len(hosts), []
        rarest = lambda tokens: min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))
        for i, (name, verdict, pattern) in enumerate(hosts):
            self.rules.append((name, verdict, re.compile(pattern)))
            self.by_token.setdefault(rarest(TOKEN.findall(name)), []).append(i)
        for i, (pattern, branches) in enumerate(patterns, len(self.rules)):
            self.rules.append((pattern, "block", re.compile(pattern)))
            if not all(branches):  # a branch without a literal token: tried on every url
                self.always.append(i)
                continue
            for token in sorted({rarest(b) for b in branches}):
                self.by_token.setdefault(token, []).append(i)

    def judge(self, host: str, path: str, rest: str) -> tuple[str | None, str]:
        """(host rule or null, verdict)."""
        # Host rules keep the letters of the path; tokens are looked up in lower case.
        text, site = (host + path + rest).lower(), host + path
        tokens = set(TOKEN.findall(text))
        candidates = sorted({i for t in tokens & self.by_token.keys() for i in self.by_token[t]} | set(self.always))
        fits = [(len(self.rules[i][0]), self.rules[i]) for i in candidates if i < self.hosts and self.rules[i][2].search(site)]
        if fits:
            _, (name, verdict, _) = max(fits, key=lambda f: f[0])
            return name, verdict
        blocked = any(i >= self.hosts and self.rules[i][2].search(text) for i in candidates)
        return None, "block" if blocked else "allow"


def rule_tokens(patterns=PATTERNS, hosts=None) -> set[str]:
    hosts = host_patterns() if hosts is None else hosts
    return {t for _, branches in patterns for b in branches for t in b} | {t for name, _, _ in hosts for t in TOKEN.findall(name)}


def token_frequency(pages: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each token of the rules, over all pages: one row for each such token."""
    held = F.explode(F.array_intersect(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1), F.array(*[F.lit(t) for t in sorted(wanted)])))
    return {r["t"]: r["n"] for r in pages.select(held.alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def judged(pages: DataFrame, patterns=PATTERNS, hosts=None) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    The longest host rule that fits decides (``rule`` names it); else the pattern rules, which
    only block; else the url is allowed. A null url, or one without ``://``, has an empty host
    and path and is allowed. Repeated rows and null ids are judged like any other, columns other
    than page_id and url are not read, an empty table gives an empty one. Nothing is shuffled
    but the counts of the rules' own tokens.
    """
    size = sum(len(p) for p, _ in patterns) + sum(len(n) for n, _, _ in (hosts or host_patterns()))
    if size > MAX_RULE_CHARS:
        raise ValueError(f"{size} characters of rules are more than every task should hold")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    index = RuleIndex(token_frequency(given, rule_tokens(patterns, hosts)), hosts, patterns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            verdicts = [index.judge(*p) for p in parts]
            yield {
                "page_id": b.column("page_id"),
                "host": [p[0] for p in parts],
                "path": [p[1] for p in parts],
                "rule": [v[0] for v in verdicts],
                "verdict": [v[1] for v in verdicts],
            }

    return arrow_map(given, each, "page_id long, host string, path string, rule string, verdict string")
