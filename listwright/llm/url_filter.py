"""URL filter: host and path rules, then a weighted vocabulary found with Aho-Corasick.

A rule names a host and the beginning of a path (``example.net/en/``); it fits the host and its subdomains where
the path begins with the rule's. The longest fitting rule decides. Where none fits, all terms of the vocabulary are looked up in one pass over
the URL; a hit counts only between characters other than a-z and 0-9. One strict term, or ``MIN_SOFT`` different
soft terms, block the URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, so no rule fits; a null URL has no
hits and is allowed. Repeated rows are judged each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from listwright.llm.common import map_rows

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Weighted vocabulary: a strict term alone blocks.
STRICT = {"casino": 5.0, "gambling": 5.0, "jackpot": 4.0, "poker": 4.0, "porn": 5.0, "sex": 4.0, "viagra": 5.0, "warez": 4.0, "xxx": 5.0}
SOFT = {
    "ads": 1.0, "adult": 1.5, "bet": 1.0, "bets": 1.0, "bonus": 1.0, "buy": 0.5, "cheap": 1.0, "click": 0.5, "coupon": 0.5, "credit": 0.5, "deal": 0.5, "deals": 0.5, "free": 0.5,
    "loan": 1.0, "loans": 1.0, "lottery": 1.5, "nude": 1.5, "pharmacy": 1.0, "pills": 1.5, "promo": 0.5, "spam": 1.5, "track": 0.5, "tracker": 0.5, "win": 0.5, "winner": 0.5,
}
MIN_SOFT = 2
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double"


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path): the host ends at /, ? or #, the path at ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: slash if slash >= 0 else end]
    return host.encode().lower().decode(), rest[slash:end] if slash >= 0 else ""


def fitting(host: str, path: str, rules) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict."""
    best = None
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def automaton(strict: dict[str, float], soft: dict[str, float]):
    found = ahocorasick.Automaton()
    for terms, is_strict in ((strict, True), (soft, False)):
        for term, weight in terms.items():
            found.add_word(term, (term, weight, is_strict))
    found.make_automaton()
    return found


def hits(url: str | None, terms) -> tuple[int, int, float]:
    """(different strict terms, different soft terms, weight of all occurrences) between word boundaries."""
    text = (url or "").encode().lower().decode()
    strict, soft, total = set(), set(), 0.0
    inside = lambda i: 0 <= i < len(text) and text[i] in "abcdefghijklmnopqrstuvwxyz0123456789"
    for end, (term, weight, is_strict) in terms.iter(text):
        if not inside(end + 1) and not inside(end - len(term)):
            (strict if is_strict else soft).add(term)
            total += weight
    return len(strict), len(soft), total


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """One row per page: host, path, the deciding rule or null, the verdict and the hits of the vocabulary."""

    def make():
        terms = automaton(strict, soft)

        def work(ids, urls):
            rows = []
            for page_id, url in zip(ids, urls):
                host, path = split_url(url)
                n_strict, n_soft, weight = hits(url, terms)
                rule = fitting(host, path, rules)
                verdict = rule[1] if rule else "block" if n_strict or n_soft >= min_soft else "allow"
                rows.append((page_id, host, path, rule[0] if rule else None, verdict, n_strict, n_soft, weight))
            yield rows

        return work

    return map_rows(pages.selectExpr("cast(page_id as long) page_id", "url"), make, SCHEMA)
