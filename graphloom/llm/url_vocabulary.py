"""URL filter: host rules, then a weighted vocabulary of strict and soft terms.

All terms are looked up with one Aho-Corasick automaton in one pass over the URLs of a
batch, laid end to end; a hit counts only between boundaries (no letter, digit or byte
outside ASCII beside it, or the end of the URL). Distinct terms add up their weights:
one strict term or several distinct soft ones reach the limit.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bytewords import Texts
from graphloom.llm.common import text_function, text_of


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # this host and all below it
    path: str = "/"  # what the path starts with


# The host rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

# Lower-case terms. A strict one rejects alone, soft ones together.
STRICT = ("camgirls", "casino", "cialis", "escort", "gambling", "hentai", "online-poker", "porn", "porno", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "bet", "betting", "bonus", "cam", "cheap", "click", "coupon", "crack", "dating", "deal", "doubleclick", "erotic",
        "free-spins", "girls", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "naked", "nude", "payday", "pharmacy", "pills", "poker",
        "popup", "promo", "replica", "sale", "sex", "sexy", "slots", "spam", "torrent", "track", "tracker", "tracking", "win", "x")

SOFT_WEIGHT = 1
#: Weight at which a URL is rejected: that of one strict term, or of two soft ones.
LIMIT = 2

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_INSIDE = np.array([48 <= c <= 57 or 97 <= c <= 122 or c > 127 for c in range(256)])


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    finder = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        # Bytes as characters of one byte: places are places in the bytes.
        finder.add_word(term.encode().decode("latin-1"), i)
    if terms:
        finder.make_automaton()
    return finder, np.array([len(term.encode()) for term in terms], np.int64)


def hits(t: Texts, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every place of a term between boundaries, in text order."""
    buf = _LOWER[t.buf]
    finder, length = _automaton(terms)
    got = list(finder.iter(buf.tobytes().decode("latin-1"))) if terms and len(buf) else []
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last, term = np.array(got, np.int64).T
    first = last + 1 - length[term]
    doc = t.doc_of(first)
    low, high = t.offsets[doc], t.offsets[doc + 1]
    whole = last < high
    left = (first == low) | ~_INSIDE[buf[np.maximum(first - 1, 0)]]
    right = (last + 1 == high) | ~_INSIDE[buf[np.minimum(last + 1, len(buf) - 1)]]
    good = whole & left & right
    return doc[good], term[good]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does; of
    equally long ones that of the longer host."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


COUNTED = T.StructType([T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType()), T.StructField("strict_terms", T.LongType()),
                        T.StructField("soft_terms", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, limit: int = LIMIT,
          url: str = "url", into: str = "_url") -> DataFrame:
    """pages with one more column `into`, a struct: host, path, rule, strict_hits and
    soft_hits (all places), strict_terms and soft_terms (distinct), terms (distinct, in
    order), weight, verdict (allow or block).

    A rule decides where one fits. Elsewhere block means that the weight, `limit` for
    each distinct strict term and 1 for each distinct soft one, is at least `limit`.
    Terms may stand anywhere in the URL. Null URLs and those without :// have an empty
    host and path; a null or empty URL has no term and is allowed. Each row is judged
    by itself: repeated rows alike, no rows give none, long URLs whole. Other columns
    pass through; an own column of the name `into` is an error."""
    if into in pages.columns:
        raise ValueError(f"pages has a column {into} already; name another with into=")
    strict, soft = tuple(sorted(set(strict))), tuple(sorted(set(soft) - set(strict)))
    terms = strict + soft

    def run(t: Texts):
        n = len(t.offsets) - 1
        doc, term = hits(t, terms)
        is_strict = term < len(strict)
        pairs = np.unique(doc * max(1, len(terms)) + term)
        of, which = pairs // max(1, len(terms)), pairs % max(1, len(terms))
        cuts = np.searchsorted(of, np.arange(n + 1))
        names = [sorted(terms[k] for k in which[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"strict_hits": np.bincount(doc[is_strict], minlength=n), "soft_hits": np.bincount(doc[~is_strict], minlength=n),
                "strict_terms": np.bincount(of[which < len(strict)], minlength=n), "soft_terms": np.bincount(of[which >= len(strict)], minlength=n),
                "terms": names}

    out = pages.withColumn(into, text_function(COUNTED, run)(text_of(url)))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    weight = F.col(into)["strict_terms"] * limit + F.col(into)["soft_terms"] * SOFT_WEIGHT
    rule = rule_of(host, path, rules)
    counted = [F.col(into)[name].alias(name) for name in COUNTED.names]
    verdict = F.coalesce(rule["verdict"], F.when(weight >= limit, "block").otherwise("allow"))
    return out.withColumn(into, F.struct(host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), *counted,
                                         weight.alias("weight"), verdict.alias("verdict")))
