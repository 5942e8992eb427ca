"""Quality classifier from positive and unlabelled documents.

Trusted positives and unlabelled texts only: a linear model over binned text statistics
minimises the non-negative unbiased risk pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with
the logistic loss, where pi, the share of good documents, is estimated from the same two
samples: where the scores of one half's model separate best, unlabelled texts are at least
as many as pi times the positives.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bytewords as bw
from graphloom.llm.common import remainder, smallest, text_function, text_of
from graphloom.llm.decision_rules import measure

BINS = 16
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?|*$%&#<>")] = True


def statistics(t: bw.Texts) -> np.ndarray:
    """One row of figures per text: counts, shares, and how words begin and end."""
    got = measure(t)
    w = bw.words(t)
    n = len(t.offsets) - 1
    total = np.maximum(got["n_words"], 1)
    last, first = t.buf[w.end - 1], t.buf[w.start]
    two = ENDS[last] & ENDS[t.buf[np.maximum(w.end - 2, w.start)]] & (w.end - w.start > 2)
    extra = [np.bincount(w.doc[hit], minlength=n) / total for hit in (ENDS[last], two, (first >= 65) & (first <= 90), w.end - w.start > 12)]
    spread = got["distinct_share"] * np.sqrt(total)
    columns = [np.log1p(got["n_words"]), np.log1p(got["n_symbols"]), np.log1p(got["n_repeat_words"]), np.log1p(got["n_dup_lines"]),
               spread, *(v for k, v in got.items() if not k.startswith("n_")), *extra]
    return np.column_stack(columns) if n else np.zeros((0, len(columns)))


class Model(NamedTuple):
    edges: np.ndarray  # figures x (BINS - 1)
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_binned(x, self.edges) @ self.weights + self.bias, -30, 30)))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0/1 columns: the figure is above the edge. Sums of such steps are step functions."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float32)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4,
          slack: float = 0.0) -> Model:
    """Gradient descent (Adam) on the non-negative risk: where R_u(-) - prior * R_p(-)
    falls below -slack, the step goes up that part instead. Without positives or
    without unlabelled rows the score is the prior."""
    width = (positive if len(positive) else unlabelled).shape[1]
    pool = np.vstack([positive.reshape(-1, width), unlabelled.reshape(-1, width)])
    edges = np.quantile(pool, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(pool) else np.zeros((width, BINS - 1))
    bias = float(np.log(prior / (1 - prior)))
    weights = np.zeros(edges.size)
    if not len(positive) or not len(unlabelled):
        return Model(edges, weights, bias, prior)
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    m, v = np.zeros(edges.size + 1), np.zeros(edges.size + 1)

    def slope(x, sign):  # of the mean of log(1 + exp(-sign * f))
        f = x @ weights.astype(np.float32) + bias
        g = -sign / (1 + np.exp(np.clip(sign * f, -30, 30)))
        return np.append(x.T @ g.astype(np.float32), g.sum()) / len(x), np.logaddexp(0, -sign * f).mean()

    for step in range(1, rounds + 1):
        (gp, _), (gpn, rpn), (gu, ru) = slope(p, 1), slope(p, -1), slope(u, -1)
        rest = gu - prior * gpn
        g = prior * gp + rest if ru - prior * rpn >= -slack else -rest
        g = g + decay * np.append(weights, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(edges, weights, bias, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.05) -> float:
    """Share of positives among the unlabelled rows, from no other labels.

    A model of one half (positives against unlabelled) scores the other half. Above any
    score the unlabelled share is pi times the positive one plus what others add, so the
    ratio is never below pi; it is read where ratio plus sampling error is least. Kept
    within 0.02 and 0.98; 0.5 where a half has no rows."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        model = train(positive[k::2], unlabelled[k::2], 0.5, rounds=150)
        p, u = (np.sort(model.score(x[1 - k :: 2])) for x in (positive, unlabelled))
        cuts = np.unique(np.concatenate([p, u]))
        above_p = 1 - np.searchsorted(p, cuts) / len(p)
        above_u = 1 - np.searchsorted(u, cuts) / len(u)
        error = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        some = above_p > 0
        best = np.argmin((above_u[some] + error) / above_p[some])
        found.append(above_u[some][best] / above_p[some][best])
    return float(min(0.98, max(0.02, np.mean(found))))


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The non-negative unbiased risk that `train` goes down."""
    def loss(x, sign):
        return np.logaddexp(0, -sign * (_binned(x, model.edges) @ model.weights + model.bias)).mean()

    return float(model.prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - model.prior * loss(positive, -1)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000, held: int = 2, parts: int = 4, seed: int = 5) -> Model:
    """Positives: labelled good documents; unlabelled: any documents; both outside the
    held-out part (crc32 of doc_id's text modulo `parts` is `held`), at most `sample`
    rows each, those with the smallest hashes. Labels of bad documents are not used; the
    prior comes from the two samples (`estimate_prior`)."""
    open_rows = remainder("doc_id", parts) != held
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    marks = labels.where("doc_id is not null and quality is not null").where(open_rows)
    texts = docs.select("doc_id", "text").where(open_rows)
    trusted = smallest(marks.where("quality = 1").select("doc_id").distinct(), key, sample, "doc_id")
    stats = text_function("x array<double>", lambda t: {"x": list(statistics(t))})

    def rows(df, order):
        got = df.withColumn("_x", stats(text_of())).select("doc_id", F.col("_x.x").alias("_x")).orderBy(order, "doc_id", "_x").limit(sample)
        return np.array([r[0] for r in got.select("_x").collect()], float)

    some = smallest(docs.select("doc_id").where(open_rows), F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed + 1)), sample, "doc_id").distinct()
    chosen = texts.join(F.broadcast(some), "doc_id", "left_semi")
    p = rows(texts.join(F.broadcast(trusted), "doc_id", "left_semi"), key)
    u = rows(chosen, F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed + 1)))
    width = len(statistics(bw.Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64)))[0])
    p, u = p.reshape(-1, width), u.reshape(-1, width)
    return train(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model, into: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each whole text, 0 to 1; null and empty texts are scored
    as texts without words. Other columns pass through."""
    run = text_function("score double", lambda t: {"score": model.score(statistics(t))})
    return docs.withColumn(into, run(text_of(text))["score"])
