"""URL filter: regular-expression rules indexed by their rarest literal token.

Every rule names the literal tokens that any URL it matches must contain. Token counts over all URLs decide which of
a rule's tokens is the rarest; the rule is filed under that one. A URL's own tokens fetch the candidate rules and only
those run their regular expression, so the cost per URL follows the candidates, not the number of rules. No shuffle
of the URLs takes place.

Edge cases: a null URL, an empty one and one without ``://`` have empty host and path and no tokens of theirs; they get
the default verdict. A rule without a token is filed under the empty one and runs on every URL. Repeated rows and repeated
or null ids give a row each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)
_SPLIT = re.compile("[^a-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """A pattern is matched from the start of host + path; tokens are literals (a-z0-9) that every match contains whole.

    A rule without tokens is run on every URL. rank: the fitting rule with the largest rank, then name, decides.
    A rule whose reported is false decides the verdict but is not named in the result.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    reported: bool = True


def host_path_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host, its subdomains and paths that start with path; longer rules win."""
    tokens = [t for t in _SPLIT.split(host.translate(_ASCII)) if t]
    tokens += [t for t in _SPLIT.split(path.translate(_ASCII))[:-1] if t]  # the last may go on in the URL
    return UrlRule(host + path, rf"(?s)(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), verdict, len(host + path))


def token_rule(name: str, pattern: str, tokens: Iterable[str], verdict: str) -> UrlRule:
    """A rule on the host and path that any host rule overrides."""
    return UrlRule(name, pattern, tuple(tokens), verdict, -1, reported=False)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_ASCII), re.match(r"[^?#]*", rest[len(host) :])[0]


def token_counts(urls: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each wanted token occurs; the result is as large as the rule list at most."""
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))).alias("token"))
    counted = tokens.join(small(asked), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def filter_urls(urls: DataFrame, rules: list[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id, host, path, rule (the deciding rule's name or null) and verdict.

    Rules are broadcast: a list that a driver holds. Ids pass through untouched, null ones too.
    """
    spark = urls.sparkSession
    source = urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(source, "url", wanted) if wanted else {}
    index: dict[str, list[UrlRule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(rule)
    shared = spark.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, list] = {}

        def filed(token: str) -> list:
            if token not in compiled:
                compiled[token] = [(re.compile(r.pattern), r) for r in shared.value.get(token, ())]
            return compiled[token]

        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                where = host + path
                best = None
                for token in {*_SPLIT.split(where.translate(_ASCII)), ""}:
                    for pattern, rule in filed(token) if token in shared.value else ():
                        if (best is None or (rule.rank, rule.name) > (best.rank, best.name)) and pattern.match(where):
                            best = rule
                rows.append((host, path, best.name if best and best.reported else None, best.verdict if best else default))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in zip(*rows, strict=True)]], ["id", "host", "path", "rule", "verdict"])

    return map_arrow(source, judge, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


#: The rules of the query.
PAGE_RULES = [
    host_path_rule("org", "/", "allow"),
    host_path_rule("example.org", "/es/", "block"),
    host_path_rule("example.org", "/en/1", "block"),
    host_path_rule("com", "/fr/", "allow"),
    host_path_rule("com", "/de/", "block"),
    *[token_rule(f"account pages: {x}", rf"(?s)[^/]*/(?:.*/)?{x}(?:[/.]|\Z)", (x,), "block") for x in ("login", "signup", "signin", "checkout", "cart")],
    token_rule("ad hosts", r"(?s)(?:[^/]*\.)?doubleclick\.[^/.]+/", ("doubleclick",), "block"),
    token_rule("feeds", r"(?s).*/wp-json/", ("wp", "json"), "block"),
]
