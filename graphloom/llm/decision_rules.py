"""Quality rules: decision lists learned from labelled statistics by sequential covering."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bytewords as bw
from graphloom.llm.common import smallest, text_function, text_of

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
RATIOS = ("word_len", "symbol_share", "upper_share", "digit_share", "mark_share", "lone_share", "dup_line_share",
          "repeat_share", "distinct_share", "line_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?;:=_~^@/\\")] = True


def measure(t: bw.Texts) -> dict[str, np.ndarray]:
    """Counts and shares of each text; shares of nothing are 0."""
    n = len(t.offsets) - 1
    w = bw.words(t)
    inside = ~bw.SPACE[t.buf]
    n_words = np.bincount(w.doc, minlength=n)
    chars = t.total(inside & ((t.buf & 0xC0) != 0x80))
    symbols = t.total(SYMBOL[t.buf])
    upper = t.total((t.buf >= 65) & (t.buf <= 90))
    letters = upper + t.total((t.buf >= 97) & (t.buf <= 122))
    digits = t.total((t.buf >= 48) & (t.buf <= 57))
    marks = t.total(MARK[t.buf])
    lone = np.bincount(w.doc[w.end - w.start == 1], minlength=n)

    ln = bw.lines(t)
    first_word = np.searchsorted(w.start, ln.start)
    full = np.searchsorted(w.start, ln.end) > first_word
    line_key = bw.mix(t.hashes(ln.start[full], ln.end[full]) + ln.doc[full].astype(np.uint64) * bw.BASE)
    _, firsts = np.unique(line_key, return_index=True)
    n_lines = np.bincount(ln.doc[full], minlength=n)
    dup_lines = n_lines - np.bincount(ln.doc[full][firsts], minlength=n)

    h = t.hashes(w.start, w.end)
    g, at = bw.grams(h, w.doc, 5)
    hit = bw.covered(len(h), at[bw.repeated(g, w.doc[at])], 5)
    repeat = np.bincount(w.doc[hit], minlength=n)
    _, kinds = np.unique(bw.mix(h + w.doc.astype(np.uint64) * bw.BASE), return_index=True)
    distinct = np.bincount(w.doc[kinds], minlength=n)

    def share(a, b):
        return a / np.maximum(b, 1)

    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "word_len": share(chars, n_words), "symbol_share": share(symbols, chars), "upper_share": share(upper, letters),
        "digit_share": share(digits, chars), "mark_share": share(marks, chars), "lone_share": share(lone, n_words),
        "dup_line_share": share(dup_lines, n_lines), "repeat_share": share(repeat, n_words),
        "distinct_share": share(distinct, n_words), "line_words": share(n_words, n_lines),
    }


_stats = text_function(COUNTS + "".join(f", {r} double" for r in RATIOS), measure)


def with_statistics(docs: DataFrame, into: str = "_stats", text: str = "text") -> DataFrame:
    """docs with one more column: a struct of the counts and shares of the whole text."""
    return docs.withColumn(into, _stats(text_of(text)))


class Rule(NamedTuple):
    """All of (statistic, is_above, threshold) hold => the document is bad (or good)."""

    tests: tuple[tuple[str, bool, float], ...]
    keep: bool
    right: int
    wrong: int


def _foil(p: int, n: int, p0: int, n0: int) -> float:
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _cuts(values: np.ndarray, most: int) -> np.ndarray:
    kinds = np.unique(values)
    mid = (kinds[1:] + kinds[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def _grow(x, bad, names, cuts, longest):
    """Adds the threshold test of largest information gain until no good row is left."""
    rows, tests = np.ones(len(bad), bool), []
    while len(tests) < longest and (~bad[rows]).any():
        p0, n0 = int(bad[rows].sum()), int((~bad[rows]).sum())
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            v, b = x[rows, j], bad[rows]
            order = np.argsort(v, kind="stable")
            p_up = np.concatenate([[0], np.cumsum(b[order])])
            k = np.searchsorted(v[order], cuts[j], "right")
            for above in (False, True):
                p = p0 - p_up[k] if above else p_up[k]
                m = (len(v) - k if above else k) - p
                gain = np.where(p > 0, _foil(p, m, p0, n0), -1)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (j, above, float(cuts[j][i])), None)
        if best[1] is None:
            break
        tests.append(best[1])
        rows &= _holds(x, [best[1]])
    return tests


def _holds(x, tests):
    rows = np.ones(len(x), bool)
    for j, above, cut in tests:
        rows &= (x[:, j] > cut) == above
    return rows


def _prune(tests, x, bad):
    """Drops final tests while (right - wrong) / covered on the pruning rows doesn't fall."""

    def worth(some):
        rows = _holds(x, some)
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    options = [tests[: k + 1] for k in range(len(tests))]
    return max(options, key=lambda o: (worth(o), -len(o))) if options else tests


def learn(x: np.ndarray, good: np.ndarray, names: list[str], seed: int = 7, most_rules: int = 24, longest: int = 4,
          least_precision: float = 0.9, most_cuts: int = 200) -> list[Rule]:
    """Sequential covering for the bad rows: grow a rule on two thirds of the rows that
    are left, prune it on the third, keep it if it is right for `least_precision` of
    all rows it covers (and a thousandth of the rows at least), take away what it covers, and go on. One class only, or no
    rows: no rules (everything is kept)."""
    rng = np.random.default_rng(seed)
    left, bad, rules, misses = np.arange(len(good)), ~good.astype(bool), [], 0
    cuts = [_cuts(x[:, j], most_cuts) for j in range(x.shape[1])]
    while bad[left].any() and len(rules) < most_rules and misses < 3:
        rows = rng.permutation(left)
        grow, prune = rows[: max(1, len(rows) * 2 // 3)], rows[len(rows) * 2 // 3 :]
        tests = _grow(x[grow], bad[grow], names, cuts, longest) if bad[grow].any() else []
        tests = _prune(tests, x[prune], bad[prune])
        held = left[_holds(x[left], tests)] if tests else left[:0]
        right, wrong = int(bad[held].sum()), int((~bad[held]).sum())
        if not tests or right < max(3, 0.001 * len(good)) or right < least_precision * (right + wrong):
            misses += 1
            continue
        misses = 0
        rules.append(Rule(tuple((names[j], above, cut) for j, above, cut in tests), False, right, wrong))
        left = left[~_holds(x[left], tests)]
    return rules


def as_column(rules: list[Rule], stats: str = "_stats") -> Column:
    """The ordered list as one conditional expression: true keeps the document."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, above, cut in rule.tests:
            value = F.col(f"{stats}.{name}").cast("double")
            test = test & (value > cut if above else value <= cut)
        out = F.when(test, F.lit(rule.keep)) if out is None else out.when(test, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, seed: int = 7) -> list[Rule]:
    """A decision list from labelled documents.

    `sample` bounds the labelled rows of the fit (those with the smallest hashes of
    doc_id). Rows without quality or doc_id aren't labels. Copies of one doc_id count
    as often as they occur, `sample` rows at most in all."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    marks = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("_good"))
    marks = smallest(marks, key, sample, "_good")
    some = docs.select("doc_id", F.col("text")).join(F.broadcast(marks), "doc_id")
    names = [*(c.split()[0] for c in COUNTS.split(", ")), *RATIOS]
    rows = (with_statistics(some).select("doc_id", "_good", *[F.col(f"_stats.{c}").cast("double").alias(c) for c in names])
            .orderBy(key, "_good", *names).limit(sample).collect())
    if not rows:
        return []
    table = np.array([tuple(r)[1:] for r in rows], float)
    return learn(table[:, 1:], table[:, 0] >= 0.5, names, seed)


def base_failed(stats: str = "_stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 10) | (100 * F.col(f"{stats}.n_repeat_words") > 20 * n)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with _stats, base_failed and kept. Null and empty texts have no words and
    fail; other columns pass through; no rows give no rows."""
    out = with_statistics(docs)
    failed = base_failed()
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & as_column(rules))
