"""Copies of benchmark items with regular edits, and the bound before alignment."""

import random

from graphloom.llm import decontaminate
from tests.llm import common


def replaced(words, k):
    return [f"new{i}" if i % k == k - 1 else w for i, w in enumerate(words)]


def inserted(words, k):
    return [x for i, w in enumerate(words) for x in ([w, f"new{i}"] if i % k == k - 1 else [w])]


def items(spark):
    rng = random.Random(21)
    made = [[f"i{k}w{j}" for j in range(rng.choice([20, 30, 40, 59]))] for k in range(6)]
    return made, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "item_id long, text string")


def test_regular_edits(spark):
    made, bench = items(spark)
    copies = [(0, replaced(made[0], 5)), (1, replaced(made[1], 6)), (2, inserted(made[2], 3)), (3, inserted(made[3], 4))]
    docs = [common.Row(k, " ".join(["before"] * 70 + w + ["after"] * 70), None, None, None, *"abcdefgh") for k, w in copies]
    got = decontaminate.leaks(common.frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k, _ in copies}
    for r in got:
        words = docs[r.doc_id].text.split()
        assert r.score == decontaminate.align(words, made[r.item_id])[0] >= 0.6


def test_light_and_heavy_copy(spark):
    made, bench = items(spark)
    light, heavy = list(made[4]), replaced(made[4], 5)
    light[3] = "other"
    docs = [common.Row(0, " ".join(light), None, None, None, *"abcdefgh"), common.Row(1, " ".join(heavy), None, None, None, *"abcdefgh"),
            common.Row(2, " ".join(light + ["between"] * 200 + replaced(made[5], 5)), None, None, None, *"abcdefgh")]
    got = decontaminate.leaks(common.frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 4), (1, 4), (2, 4), (2, 5)}


def test_bound_loses_nothing():
    rng = random.Random(8)
    kept = 0
    for _ in range(1500):
        vocabulary = [f"v{i}" for i in range(rng.choice([3, 8, 30]))]
        item = [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        copy = [w for w in item if rng.random() > 0.15]
        copy = [x for w in copy for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.3 else [w])]
        passage = [rng.choice(vocabulary + ["x", "y", "z"]) for _ in range(rng.randint(0, 60))] + copy + ["x"] * rng.randint(0, 60)
        whole = decontaminate.align(passage, item)
        least = rng.choice([0.3, 0.6, 0.9])
        low, high = decontaminate.reach_of(passage, item, least)
        if whole[0] >= least:
            part = decontaminate.align(passage[low:high], item)
            assert (part[0], part[1] + low, part[2] + low) == whole
            kept += 1
    assert kept > 300


def test_items_without_a_number_and_clashing_names(spark):
    words = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(None, words), (None, "a b"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + words, 5, "x", "y"), (2, "other words here", 6, "x", "y"), (None, words, 7, "x", "y"), (4, None, 8, "x", "y")],
                                 "doc_id long, text string, _th long, _id string, _h string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(0, None), (1, None)]
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r._th, r._id, r._h) for r in left.collect()) == [(2, 6, "x", "y"), (4, 8, "x", "y")]
    assert decontaminate.without_leaks(docs, bench.where("false")).count() == 4
