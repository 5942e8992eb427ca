"""Array helpers and models against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import budget_mix, chat_windows, crf_pii, ctw, decision_rules, decontaminate, license_scan, probminhash, pu_quality
from graphloom.llm import bytewords as bw

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = st.text(alphabet="ab \n\t\r\x0b\x0c|!é日<\\>", max_size=60)


def one(text):
    raw = text.encode()
    return bw.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=6))
def test_counts_of_texts(texts):
    got = {}
    for _, _, t in bw.slices(pa.array(texts, pa.string()), 40):
        for k, v in decision_rules.measure(t).items():
            got.setdefault(k, []).extend(v)
    for i, text in enumerate(x or "" for x in texts):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        five = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if five[tuple(words[k : k + 5])] > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    bad = ((x[:, 0] > 0.8) & (x[:, 2] <= 0.5)) | (x[:, 1] > 0.9)
    rules = decision_rules.learn(x, ~bad, list("abcd"))
    verdict = np.zeros(3000, bool)
    for r in rules:
        verdict |= decision_rules._holds(x, [("abcd".index(c), up, cut) for c, up, cut in r.tests])
    assert (verdict == bad).mean() > 0.98
    assert decision_rules.learn(x, np.ones(3000, bool), list("abcd")) == []
    assert decision_rules.learn(x[:0], np.zeros(0, bool), list("abcd")) == []


def test_positive_unlabelled_risk_separates():
    rng = np.random.default_rng(1)
    good, poor = rng.normal(0, 1, (2000, 3)), rng.normal(2.5, 1, (2000, 3))
    unlabelled = np.vstack([good[1000:1800], poor[:200]])
    model = pu_quality.train(good[:1000], unlabelled, 0.8)
    right = ((model.score(good[1800:]) >= 0.5).mean() + (model.score(poor[200:]) < 0.5).mean()) / 2
    assert right > 0.9
    assert np.allclose(pu_quality.train(good[:0], unlabelled, 0.8).score(good), 0.8)


def test_field_decodes_as_brute_force():
    rng = np.random.default_rng(2)
    k = len(crf_pii.LABELS)
    field = crf_pii.Field(rng.normal(size=(3, crf_pii.FEATURES, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    t = one("ab +1 (2) x@y.z\nAB 12.3\n\nq w")
    w = bw.words(t)
    codes, line = crf_pii.shape_codes(t, w), crf_pii.lines_of(t, w)
    got = crf_pii.decode(field, codes, line)
    x = crf_pii.unpack(codes)
    for n in np.unique(line):
        at = np.nonzero(line == n)[0]
        e = [x[i] @ field.shape[1] + (x[i - 1] @ field.shape[0] if i > at[0] else 0) + (x[i + 1] @ field.shape[2] if i < at[-1] else 0) for i in at]
        best = max(np.ndindex(*[k] * len(at)), key=lambda y: field.first[y[0]] + sum(e[i][y[i]] for i in range(len(y))) + sum(field.pair[y[i], y[i + 1]] for i in range(len(y) - 1)))
        assert tuple(got[at]) == best


def test_field_learns_and_adds():
    rng = random.Random(4)

    def plain():
        return " ".join(rng.choice(["the", "of", "ernt", "thereof,", "Nd."]) for _ in range(12))

    lines = crf_pii._marked()
    for _ in range(120):
        phone, ip = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", ".".join(str(rng.randint(1, 255)) for _ in range(4))
        for kind, item in (("phone", phone), ("ip", ip)):
            a = plain()
            lines.append((f"{a} {item} {plain()}", [(kind, len(a) + 1, len(a) + 1 + len(item))]))
        lines.append((plain(), []))
    field = crf_pii.fit(lines)
    text = "thereof +1 (314) 555-6532 4111111111111111 the of"
    assert not [s for s in crf_pii.base_spans(text) if s[0] == "phone"]
    t = one(text)
    found = {(crf_pii.LABELS[k], text[a:b]) for _, k, a, b in crf_pii.field_spans(field, t)}
    assert ("phone", "+1 (314) 555-6532") in found
    assert crf_pii.field_spans(field, one("the of ernt thereof, Nd.")) == []
    assert crf_pii.field_spans(crf_pii.train([], []), t) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab0123@.+- ()", max_size=40))
def test_base_patterns(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    want = [("email", *m.span()) for m in crf_pii.EMAIL.finditer(text)]
    want += [("ip", *m.span()) for m in crf_pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [("card", *m.span()) for m in crf_pii.CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    want += [("phone", *m.span()) for m in crf_pii.PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    assert crf_pii.base_spans(text) == want


def test_notices():
    def scan(text):
        return license_scan.scan(text.encode().translate(license_scan._WORD).split())

    assert scan("Released under the MIT License. Under the MIT license") == [("mit", 1, 4, 0, 1.0, True), ("mit", 5, 4, 0, 1.0, True)]
    (label, word, words, edits, similarity, base), = scan("so under the MIT licence, ok")
    assert (label, word, words, edits, base) == ("mit", 1, 4, 1, False) and 0.9 < similarity < 1
    assert scan("Apache License, Version 1.0") == [] and scan("under the mpl license") == [] and scan("cc by nd") == []
    assert [m[0] for m in scan("Licenced under the Apachee Licence, Version 2.0")] == ["apache-2"]
    assert scan("xcc by nc cc by ncx") == [] and scan("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="user\\n\n<|>", max_size=8), st.text(alphabet="a<|im_start|>\\n\n", max_size=30)), max_size=4))
def test_template_round_trip(turns):
    formatted, spans = chat_windows.format_turns(turns, 0)
    assert chat_windows.read_turns(formatted) == turns
    assert [chat_windows.unescape(formatted[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def smith_waterman(a, b):
    h = [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(b)) if a and b else 0.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment(a, b):
    score, start, end = decontaminate.align(a, b)
    assert score == pytest.approx(smith_waterman(a, b))
    if score:
        assert smith_waterman(a[start:end], b) == pytest.approx(score)


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate([a[:260], rng.integers(1, 1 << 60, 40).astype(np.uint64)])
    wa = rng.integers(1, 4, 300)
    wb = wa + np.where(np.arange(300) < 50, 2, 0)
    x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)
    assert probminhash.probability_jaccard((a, wa), (b, wb)) == pytest.approx(exact)
    held = probminhash.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 8000)
    assert (held[0] == held[1]).mean() == pytest.approx(exact, abs=0.03)
    one_only = probminhash.signatures(np.zeros(1, int), a[:1], wa[:1], 2, 64)
    assert (one_only[0] == a[0]).all() and (one_only[1] == 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4)), max_size=6, unique_by=lambda p: p[0]), st.integers(0, 200))
def test_subset_is_the_largest_sum(parts, budget):
    sizes, free = [p[0] for p in parts], [p[1] for p in parts]
    got = budget_mix.subset(sizes, free, budget)
    assert all(0 <= g <= f for g, f in zip(got, free, strict=True))
    sums = {0}
    for s, f in parts:
        sums = {t + k * s for t in sums for k in range(f + 1)}
    assert sum(g * s for g, s in zip(got, sizes, strict=True)) == max(t for t in sums if t <= budget)


def test_targets():
    got = budget_mix.targets([100, 10, 1000, 0], (3, 1, 2), 1.5, 2.0)
    assert got[0] == 200 and got[3] == 0 and sum(got) == pytest.approx(1665) and got[1] == 20
    assert budget_mix.targets([], (3, 1, 2), 1.5, 2.0) == [] and budget_mix.targets([0, 0], (3, 1), 1.5, 2.0) == [0, 0]


def test_context_tree_is_the_mixture_of_all_prunings():
    """Weighted probabilities by plain recursion over bit counts."""
    rng = random.Random(3)
    data = bytes(rng.choice(b"abac") for _ in range(60))
    depth = 2
    part = [data[:40], data[40:], b""]
    gram, lengths = ctw._grams(part, depth)
    assert lengths.tolist() == [41, 21, 1] and len(gram) == 63
    u, n = np.unique(gram, return_counts=True)
    mixed, (key, zeros, ones, log_w) = ctw.subtree(u, n, depth, 1)
    totals = {}
    for k, a, b, w in zip(key, zeros, ones, log_w, strict=True):
        old = totals.get(k & 255, (0, 0, 0))
        totals[k & 255] = (old[0] + a, old[1] + b, old[2] + w)
    levels = ctw.upper_levels([(k, *v) for k, v in totals.items()], 1)
    lp = ctw.finish(u, mixed, levels, 1)

    counts = Counter()
    for g, c in zip(u.tolist(), n.tolist(), strict=True):
        context, byte = g >> 8, g & 255
        for level in range(depth + 1):
            for k in range(8):
                counts[(level, context & ((1 << 8 * level) - 1), (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1)] += c

    def log_kt(a, b):
        return sum(math.log((i + 0.5) / (i + 1)) for i in range(a)) + sum(math.log((i + 0.5) / (a + i + 1)) for i in range(b))

    def weighted(level, context, node, extra):
        """extra: (contexts by level, bit) counted once more."""
        a, b = (counts[(level, context, node, x)] + (extra is not None and extra[0][level] == context and extra[1] == x) for x in (0, 1))
        own = log_kt(a, b)
        if level == depth:
            return own
        below = sum(weighted(level + 1, context | c << 8 * level, node, extra) for c in {97, 98, 99, 255})
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    for i in range(0, len(u), 3):
        context, byte = int(u[i]) >> 8, int(u[i]) & 255
        want = 0.0
        for k in range(8):
            node = (1 << k) | byte >> (8 - k)
            at = ([context & ((1 << 8 * level) - 1) for level in range(depth + 1)], byte >> (7 - k) & 1)
            want += weighted(0, 0, node, at) - weighted(0, 0, node, None)
        assert lp[i] == pytest.approx(want, rel=1e-6)


def test_numbers_of_any_length_are_no_address():
    assert crf_pii.base_spans("x 1." + "0" * 5000 + "1.2.3 y") == [("ip", 2, 5009)]
    assert crf_pii.base_spans("x 1." + "9" * 5000 + ".2.3 y") == []
    assert not crf_pii.plausible("ip", "10.20.30.99999") and not crf_pii.plausible("ip", "1." + "9" * 5000 + ".2.3")
    assert crf_pii.plausible("ip", "10.20.30.40:80") and not crf_pii.plausible("ip", "10.20.30")
    assert not crf_pii.plausible("email", "@") and crf_pii.plausible("email", "a@b.c")
    assert not crf_pii.plausible("phone", "2023-05-17") and crf_pii.plausible("phone", "+49 30 123456")


def test_prior_and_risk_from_positives_and_unlabelled():
    rng = np.random.default_rng(8)
    for share in (0.2, 0.5, 0.85):
        good, bad = rng.normal(1.5, 1, (6000, 2)), rng.normal(-1.5, 1, (6000, 2))
        mixed = np.vstack([good[: int(4000 * share)], bad[: int(4000 * (1 - share))]])[rng.permutation(int(4000 * share) + int(4000 * (1 - share)))]
        prior = pu_quality.estimate_prior(good[-1500:], mixed)
        assert abs(prior - share) < 0.08
    p, u = good[-50:], mixed[:80]
    model = pu_quality.train(p, u, 0.4, rounds=60)

    def f(x):
        return sum(w for j, row in enumerate(model.edges) for w, edge in zip(model.weights.reshape(model.edges.shape)[j], row, strict=True) if x[j] > edge) + model.bias

    positive, negative = (lambda x: math.log1p(math.exp(-f(x)))), (lambda x: math.log1p(math.exp(f(x))))
    r_pp, r_pn, r_un = np.mean([positive(x) for x in p]), np.mean([negative(x) for x in p]), np.mean([negative(x) for x in u])
    assert abs(pu_quality.risk(model, p, u) - (0.4 * r_pp + max(0, r_un - 0.4 * r_pn))) < 1e-6
    assert pu_quality.risk(model, p, u) < pu_quality.risk(model._replace(weights=model.weights * 0), p, u)
