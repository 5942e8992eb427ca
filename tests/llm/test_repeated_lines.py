"""Near duplicates that differ in how often a line repeats."""

import random

from graphloom.llm import probminhash
from tests.llm import common


def test_repeated_lines(spark):
    rng = random.Random(12)
    docs = []
    for k, times in enumerate((2, 10, 20, 40, 60)):
        body, line = common.sentence(rng, 150), common.sentence(rng, 8)
        docs += [common.Row(10 * k, body + "\n" + line, None, None, None, *"abcdefgh"), common.Row(10 * k + 1, "\n".join([body] + [line] * times), None, None, None, *"abcdefgh")]
    docs.append(common.Row(99, common.sentence(rng, 150) + "\n" + "\n".join([line] * 60), None, None, None, *"abcdefgh"))
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(common.frame(spark, docs)).collect()}
    assert got == {r.doc_id: r.doc_id // 10 * 10 if r.doc_id < 99 else 99 for r in docs}
