"""Near duplicates in crowds: many copies with many edits meet in the same bands."""

import random

import numpy as np
import pytest

from graphloom.llm import probminhash
from tests.llm.common import SCHEMA, Row, sentence


def crowd(n, share, words=150, seed=1):
    """n copies of one text; each has 0 to 2 * share of its words replaced."""
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        edits = rng.random() * 2 * share
        out.append(" ".join(w if rng.random() > edits else sentence(rng, 1) + "q" for w in base))
    return out


def shingle_sets(texts):
    return [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]


def classes_by_hand(texts, least=0.8):
    sets, root = shingle_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both / (len(sets[i]) + len(sets[k]) - both) >= least:
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame([Row(i, t, *[None] * 3, *"abcdefgh") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("size", [32, 512])
def test_crowd_gives_the_classes_of_all_pairs(spark, size):
    texts = crowd(400, 0.04)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(frame(spark, texts), crowd=size).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def compared(spark, monkeypatch, texts):
    """How many pairs of texts are compared."""
    made = []
    kept = probminhash.written

    def watch(df, name="stage"):
        out = kept(df, name)
        if name in ("near-pairs", "near-across"):
            made.append(out.count())
        return out

    monkeypatch.setattr(probminhash, "written", watch)
    probminhash.near_duplicates(frame(spark, texts)).count()
    monkeypatch.setattr(probminhash, "written", kept)
    return sum(made)


def test_compared_pairs_stay_few_in_a_crowd(spark, monkeypatch):
    few, many = (compared(spark, monkeypatch, crowd(n, 0.2, 60)) for n in (500, 2000))
    assert few <= 6 * 500 and many <= 6 * 2000


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_sketches_and_deep_keys_keep_similar_pairs(similarity):
    rng = np.random.default_rng(3)
    size = 300
    both = round(2 * size * similarity / (1 + similarity))
    kept, near = 0, 0
    for k in range(120):
        h = rng.integers(1, 1 << 63, 2 * size - both, dtype=np.uint64)
        doc = np.repeat([0, 1], size)
        held = probminhash.signatures(doc, np.concatenate([h[:size], h[-size:]]), np.ones(2 * size), 2, 400)
        sketch = probminhash.sketches(held)
        z = (sketch[0] ^ sketch[1]).view(np.uint64)
        differ = sum(bin(int(x)).count("1") for x in (z | z >> np.uint64(1) | z >> np.uint64(2) | z >> np.uint64(3)) & np.uint64(0x1111111111111111))
        kept += differ <= probminhash.most_differences(0.8, 400)
        deep = probminhash.deep_keys(sketch, 400)
        near += bool(set(deep[0]) & set(deep[1]))
    assert kept == 120 and near >= 117


def test_differences_as_a_column(spark):
    rng = np.random.default_rng(5)
    held = rng.integers(0, 3, (40, 400)).astype(np.uint64)
    sketch = probminhash.sketches(held)
    df = spark.createDataFrame([(sketch[i].tolist(), sketch[i + 1].tolist(), i) for i in range(39)], "a array<long>, b array<long>, i int")
    from pyspark.sql import functions as F

    got = {r.i: r.d for r in df.select("i", probminhash.differences(F.col("a"), F.col("b"), 25).alias("d")).collect()}
    shown = probminhash.bw.mix(held) & np.uint64(15)
    assert all(got[i] == (shown[i] != shown[i + 1]).sum() for i in range(39))


def test_pairs_of_two_classes_are_made_once(spark, monkeypatch):
    texts, kept, made = crowd(200, 0.04), probminhash.written, []

    def watch(df, name="stage"):
        made.append(name)
        return kept(df, name)

    monkeypatch.setattr(probminhash, "written", watch)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(frame(spark, texts), crowd=32).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)
    assert made.count("near-across") == 1 and made.count("near-links") == 2  # pairs across classes joined some


def test_bands_over_the_crowd_lose_no_link(spark, monkeypatch):
    # Texts of such a band met only under a deep key that both had.
    monkeypatch.setattr(probminhash, "deep_keys", lambda sketch, *_: np.arange(len(sketch))[:, None] + (sketch[:, :1] >> 8 << 8))
    texts = crowd(400, 0.04)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(frame(spark, texts), crowd=8).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_pairs_across_classes_stay_few_in_a_crowd(spark, monkeypatch):
    assert compared(spark, monkeypatch, crowd(2000, 0.04)) <= 2 * 2000  # 13,471 before, 9,724 of them across classes


def test_parities_are_a_bound():
    rng = np.random.default_rng(9)
    for size in (4, 30, 300, 6000):
        for gone in (0, 1, size // 9, size // 2):
            h = rng.integers(1, 1 << 63, size + gone, dtype=np.uint64)
            doc = np.repeat([0, 1], size)
            x, y = probminhash.parities(doc, np.concatenate([h[:size], h[gone:]]), 2).view(np.uint64)
            differ = sum(bin(int(v)).count("1") for v in x ^ y)
            assert differ <= 2 * gone and (size > 300 or differ >= 1.5 * gone)
