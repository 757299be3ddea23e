"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal tokens (runs of letters and digits) that every match holds. Words
that may stand joined are a token together: around each word lie a few joined forms, of which every match holds one. The tokens are counted over
all URLs; each rule is filed under the token, or all the forms around the word, that fewest URLs hold. A URL's own tokens fetch the candidate
rules, and only those are run. A rule without a literal token is run on every URL.

Of the host rules that match, the longest decides; where none does, the URL is blocked if a pattern rule matches, else allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingscope.llm import wordbytes as wb

_TOKEN = re.compile(r"[a-z0-9]+")
MOST_RULES = 100_000   # rules travel with the tasks; a longer list is refused


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over the lower-cased host and the path as it is; ``tokens`` are literals of every match, in lower case.

    With ``joined``, neighbouring tokens may also stand in a match without a separator, as one token.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    host_rule: bool = False
    joined: bool = False

    def covers(self) -> list[tuple[str, ...]]:
        """Groups of tokens; every match holds at least one token of each group."""
        if not self.joined:
            return [(t,) for t in self.tokens]
        n = len(self.tokens)
        return [tuple(sorted({"".join(self.tokens[i:j]) for i in range(k + 1) for j in range(k + 1, n + 1)})) for k in range(n)]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains and every path that starts with ``path``."""
    return Rule(host + path, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(_TOKEN.findall(host.lower())), verdict, True)


def word_rule(words: str, verdict: str = "block") -> Rule:
    """The words (separated by blanks) stand next to each other in the URL, as whole tokens, with at most one separator between them."""
    tokens = tuple(words.split())
    return Rule(words, r"(?:^|[^a-z0-9])" + r"[^a-z0-9]?".join(map(re.escape, tokens)) + r"(?:[^a-z0-9]|$)", tokens, verdict, joined=True)


#: The given host rules.
HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: What the method blocks where no host rule fits: gambling, drug shops, adult pages, trackers and link farms.
PATTERN_RULES = tuple(map(word_rule, (
    "casino", "casino win", "free bets", "bets", "betting", "poker", "slots", "jackpot", "cheap pills", "pills", "viagra", "cialis", "adult", "adult x",
    "porn", "xxx", "sex", "escort", "ads track", "ads", "adserver", "doubleclick", "spam farm", "spam", "link farm", "phishing", "malware", "warez",
    "payday loan", "replica watches")))


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Both empty without ://."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(f"{host}{path}".lower()))


def index(urls: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str | None, list[Rule]]:
    """Rules by the tokens of their rarest cover over all URLs; ties go to the cover that sorts first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    asked = frozenset(t for r in rules for cover in r.covers() for t in cover)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = dict.fromkeys(asked, 0)
        for batch in batches:
            for u in batch.column(0).to_pylist():
                for t in _tokens(*host_and_path(u)) & asked:
                    found[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["token", "n"])

    counted = urls.select(url).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row per rule token
    often = {r.token: r.n for r in counted}
    by_token: dict[str | None, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.covers(), key=lambda cover: (sum(often.get(t, 0) for t in cover), cover), default=(None,))
        for token in rarest:
            by_token.setdefault(token, []).append(rule)
    return by_token


def judge(urls: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, matched) for every row; ``rule`` is the host rule that decides, ``matched`` the first pattern rule that does.

    A null URL, or one without ://, has an empty host and path, no rule, and is allowed. Patterns run over the path of a URL with an empty host too. Two host rules of one name and different verdicts are
    refused. Equal URLs get equal verdicts; other columns are not read. An empty table gives an empty table.
    """
    names = [r.name for r in rules if r.host_rule]
    if len(names) != len(set(names)):
        raise ValueError("a host rule is given twice")
    spark = urls.sparkSession
    wb.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(index(urls, rules, url))
    schema = T.StructType([T.StructField("id", urls.schema[key].dataType), *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "matched"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, compiled = shared.value, {}
        always = by_token.get(None, [])
        for batch in batches:
            rows = []
            for u in batch.column("u").to_pylist():
                host, path = host_and_path(u)
                candidates = [*always, *(r for t in sorted(_tokens(host, path)) for r in by_token.get(t, ()))]
                best = matched = None
                for r in candidates:
                    if r not in compiled:
                        compiled[r] = re.compile(r.pattern)
                    if r.host_rule and compiled[r].match(host + path):
                        if best is None or len(r.name) > len(best.name):
                            best = r
                    elif not r.host_rule and compiled[r].search((host + path).lower()):
                        matched = r if matched is None or r.name < matched.name else matched
                verdict = best.verdict if best else matched.verdict if matched else "allow"
                rows.append((host, path, best.name if best else None, verdict, matched.name if matched else None))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in columns)], schema.names)

    return urls.select(F.col(key).alias("id"), F.col(url).alias("u")).mapInArrow(run, schema).withColumnRenamed("id", key)
