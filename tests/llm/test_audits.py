"""URL vocabulary, source divergence and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bytewords as bw
from graphloom.llm import divergence, importance, url_vocabulary
from tests.llm.common import empty, frame, rows

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [None, "", "no scheme at all", "://", "http://", "HTTP://Www.Example.COM/en/1?x=/en/", "https://example.com", "https://example.com/en", "https://example.com/en/",
        "http://sub.example.com/EN/x", "http://xcom/", "http://a.net/es/1", "http://a.net/fr/2#/", "http://net/es/", "http://anet/es/", "http://u@h.org:80/a?b#c",
        "http://casino.org/", "http://casinos.org/", "http://x-casino-casino.org/x", "http://cheap-cheap.org/", "http://cheap.org/pills", "http://cheap_win.org/écheap",
        "http://q.org/free-spins/adult", "http://q.org/a\nb?porn", "éporn", "porné", "http://a.org/b://c.net/es/", "http://q.org/" + "ads/" * 50_000]


def plain_judge(url):
    url = url or ""
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].translate(ASCII_LOWER), m[2]) if m else ("", "")
    fits = [r for r in url_vocabulary.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    low = url.translate(ASCII_LOWER)
    places = {t: len(re.findall(rf"(?<![0-9a-z\u0080-\U0010ffff]){re.escape(t)}(?=[^0-9a-z\u0080-\U0010ffff]|\Z)", low))
              for t in url_vocabulary.STRICT + url_vocabulary.SOFT}
    strict = [t for t in url_vocabulary.STRICT if places[t]]
    soft = [t for t in url_vocabulary.SOFT if places[t]]
    bad = bool(strict) or len(soft) >= 2
    return (host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if bad else "allow",
            sum(places[t] for t in strict), sum(places[t] for t in soft), len(strict), len(soft), sorted(strict + soft))


def test_urls_by_hand(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_vocabulary.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        v = got[i]._url
        assert (v.host, v.path, v.rule, v.verdict, v.strict_hits, v.soft_hits, v.strict_terms, v.soft_terms, v.terms) == plain_judge(u), u
        assert got[i].verdict == "own"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="adswinxé-/. ", max_size=30), max_size=5))
def test_terms_of_a_batch_laid_end_to_end(urls):
    terms = ("ads", "win", "x", "ads-win")
    for _, _, t in bw.slices(pa.array(urls, pa.string()), 30):
        doc, term = url_vocabulary.hits(t, terms)
        for i in range(len(t.offsets) - 1):
            text = t.buf[t.offsets[i] : t.offsets[i + 1]].tobytes().decode()
            for k, name in enumerate(terms):
                want = len(re.findall(rf"(?<![0-9a-z\u0080-\U0010ffff]){name}(?=[^0-9a-z\u0080-\U0010ffff]|\Z)", text))
                assert ((doc == i) & (term == k)).sum() == want


def test_urls_without_rows_terms_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://casino.net/es/1")], "page_id long, url string")
    assert url_vocabulary.judge(pages.where("false")).collect() == []
    v = url_vocabulary.judge(pages, rules=(), strict=(), soft=()).first()._url
    assert (v.rule, v.verdict, v.weight, v.terms) == (None, "allow", 0, [])
    with pytest.raises(ValueError):
        url_vocabulary.judge(pages.withColumn("_url", pages.url))


def plain_audit(table, least=3, top=200):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in table:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(n, total):
            return 1 + 10**9 * (n + 1) // (total + len(kept))

        for s in sources:
            pairs = [(o, sum((p(counts[lang, s][t], totals[s]) - (q := p(counts[lang, o][t], totals[o]))) ** 2 // q for t in kept)) for o in sources if o != s]
            terms = []
            for t in kept:
                mine, q = p(counts[lang, s][t], totals[s]), p(sum(counts[lang, o][t] for o in sources), sum(totals.values()))
                if counts[lang, s][t] and mine > q:
                    terms.append((t, (mine - q) ** 2 // q))
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"shard_terms": 64, "bound": 4096, "cells": 1024}, {"least": 1, "top": 3}])
def test_audit_by_hand(spark, options):
    docs = frame(spark)
    got = divergence.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    want = plain_audit([(r.lang, r.source, r.text) for r in rows()], **{k: v for k, v in options.items() if k in ("least", "top")})
    assert len(found) == len(want) and set(found) == want


def test_audit_of_nothing(spark):
    assert divergence.audit(empty(spark)).collect() == []
    some = frame(spark, [r._replace(text=None) for r in rows()[:5]] + [rows()[0]._replace(text="one two", lang=None, source=None)])
    assert {tuple(r) for r in divergence.audit(some).collect()} == plain_audit([(r.lang, r.source, r.text) for r in some.collect()])


@pytest.mark.parametrize("size", [1, 2, 3, 50, 3000])
def test_perfect_hashes_are_minimal(size):
    h = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64)
    steps, slots = divergence.build(h)
    assert sorted(slots) == list(range(size))
    bucket = (bw.mix(h) % np.uint64(len(steps))).astype(np.int64)
    assert (divergence._slot(h, steps[bucket], size) == slots).all()


def test_unknown_terms_find_no_slot():
    words = pa.array([f"w{k}é" for k in range(500)], pa.large_string())
    row = divergence._build_shard(pa.table({"lang": ["x"] * 500, "term": words, "shard": [0] * 500, "shards": [1] * 500})).to_pylist()[0]
    mine = divergence.Shards([row])
    asked = pa.array([f"w{k}é" for k in range(250, 1500)] + [""], pa.large_string())
    place = mine.find(asked)
    assert sorted(place[:250]) == sorted(set(place[:250])) and (place[:250] >= 0).all() and (place[250:] == -1).all()
    assert mine.keys.take(pa.array(place[:250])).equals(asked[:250])


def test_shares_of_large_counts():
    for n, total in ((0, 1), (0, 10**9 + 7), (10**13, 3 * 10**13), (8 * 10**15, 8 * 10**15 + 5), (999_999_999, 10**9)):
        assert int(divergence.share(np.array([n]), total)[0]) == 1 + 10**9 * (n + 1) // total


def plain_features(text, n=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é日 \x00\x7f-", max_size=40)), max_size=6), st.integers(1, 3))
def test_features_of_a_batch(texts, n):
    for first, last, t in bw.slices(pa.array(texts, pa.string()), 40):
        f = importance.features(t, n, 97)
        for i in range(last - first):
            words, want = plain_features(texts[first + i], n)
            assert f.words[i] == len(words)
            assert Counter(f.bucket[f.doc == i]) == Counter(zlib.crc32(x.encode()) % 97 for x in want)


def plain_draw(docs, target, share=25, least=20, seed=7, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text)[1]) for texts in ([d[1] for d in docs], target))
    a, b = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, found = plain_features(text)
        gain = [math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted([r for r in out if r[4] >= least], key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[4], r[1]))
    taken = able[: share * len(able) // 100]
    place = {id(r): k for k, r in enumerate(taken, 1)}
    return Counter((*r[:4], place.get(id(r))) for r in out)


@pytest.mark.parametrize("share", [25, 100, 0])
def test_draw_by_hand(spark, share):
    docs, target = frame(spark), frame(spark, rows()[:6])
    got = importance.draw(importance.weigh(docs, target), share=share)
    assert got.columns == [*docs.columns, "_importance"]
    found = Counter((r.doc_id, *[r._importance[c] for c in ("n_features", "weight", "score", "rank")]) for r in got.collect())
    assert found == plain_draw([(r.doc_id, r.text) for r in rows()], [r.text for r in rows()[:6]], share)


def test_draw_from_nothing(spark):
    assert importance.draw(importance.weigh(empty(spark), frame(spark))).collect() == []
    got = importance.draw(importance.weigh(frame(spark), empty(spark))).collect()
    assert len(got) == len(rows())
    with pytest.raises(ValueError):
        importance.weigh(frame(spark).withColumnRenamed("kept", "_importance"), empty(spark))


def test_draw_of_equal_texts(spark):
    some = [r._replace(doc_id=k, text=rows()[0].text) for k, r in enumerate([rows()[0]] * 40)]
    got = importance.draw(importance.weigh(frame(spark, some), frame(spark, rows()[:6])), least_words=1).collect()
    ranks = sorted(r._importance.rank for r in got if r._importance.rank)
    assert ranks == list(range(1, 11))
