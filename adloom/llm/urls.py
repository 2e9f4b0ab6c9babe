"""URL filter: a weighted vocabulary searched with an Aho-Corasick automaton, and rules.

The automaton finds every term of the vocabulary in one pass over the lower-cased url. A
hit counts if no letter or digit touches it on either side. One strict term blocks a url;
soft terms block it when ``SOFT_HITS`` different ones occur. Rules for hosts and paths go
first: the longest rule that fits decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The vocabulary, in English and the other languages of the pages.
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirl", "camgirls", "milf", "gangbang",
          "blowjob", "creampie", "bdsm", "nsfw", "escort", "escorts", "warez", "keygen", "phishing", "malware")
SOFT = ("sex", "sexy", "sexo", "sexe", "adult", "nude", "nackt", "desnuda", "naked", "hot", "girls", "teen",
        "webcam", "dating", "casino", "poker", "bet", "betting", "slots", "jackpot", "viagra", "cialis", "pills",
        "crack", "serial", "torrent", "free", "cheap", "click", "spam", "loan", "bonus")
SOFT_HITS = 2
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_HOST = "(?s)^.*?://([^/?#]*)"
_PATH = "(?s)^.*?://[^/?#]*([^?#]*)"


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:  # a term on both lists is strict
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[set[str], set[str]]:
    """The strict and the soft terms of a url that is lower-cased already."""
    found: tuple[set[str], set[str]] = set(), set()
    for end, (term, is_strict) in _automaton(strict, soft).iter(url):
        if _edge(url, end + 1) and _edge(url, end - len(term)):
            found[not is_strict].add(term)
    return found


def _rule(host: str, path: str, rules: Mapping[str, Sequence[str]]) -> str | None:
    """The longest rule for the host or a domain above it whose path the url's path starts with."""
    fits = []
    while host:
        fits += [host + p for p in rules.get(host, ()) if path.startswith(p)]
        host = host.partition(".")[2]
    return max(fits, key=lambda r: (len(r), r), default=None)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page.

    A url that is null or has no ``://`` has an empty host and path, so no rule fits; the
    vocabulary still judges its text (null: allow). An empty host never matches a rule.
    Host labels are compared in A-Z-insensitive form, paths as they stand. Repeated rows
    stay; extra columns are ignored. Rules and terms are parameters, so bounded.
    """
    strict, soft = tuple(strict), tuple(soft)
    verdicts = dict(rules)
    by_host: dict[str, list[str]] = {}
    for rule in verdicts:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append(slash + path)
    if not strict and not soft:
        soft = ("",)  # an automaton needs a word

    @F.pandas_udf("rule string, verdict string")
    def decide(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, hosts, paths in parts:
            out = []
            for url, host, path in zip(urls, hosts, paths):
                rule = _rule(host, path, by_host)
                if rule is None:
                    bad, doubtful = hits(url, strict, soft)
                    out.append((None, "block" if bad or len(doubtful) >= soft_hits else "allow"))
                else:
                    out.append((rule, verdicts[rule]))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    def lower(c):
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(
        "page_id",
        lower(F.regexp_extract(url, _HOST, 1)).alias("host"),
        F.regexp_extract(url, _PATH, 1).alias("path"),
        lower(url).alias("lowered"),
    )
    return parts.withColumn("d", decide("lowered", "host", "path")).select(
        "page_id", "host", "path", "d.rule", "d.verdict"
    )
