"""Notices within their edits, beside others that spoil or hide them."""

import random

from graphloom.llm import license_scan
from graphloom.llm.license_scan import NOTICES, Notice, scan


def found(text):
    return [(m[0], m[1], m[3]) for m in scan(text.encode().split())]


def full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_neighbours_hide_nothing():
    got = found("gnu general publc licence version 3 or gnu general public license version 2")
    assert ("gpl-3", 0, 2) in got and ("gpl-2", 7, 0) in got and not any(m[0] == "gpl-3" and m[1] > 0 for m in got)
    assert [m for m in found("undr the mit licence undr the mit license") if m[0] == "mit"] == [("mit", 0, 2), ("mit", 4, 1)]
    assert ("mit", 2, 1) in found("is the undr the mit license the under the")
    assert ("all-rights-reserved", 0, 1) in found("all rights reserveds")


def test_as_all_spans():
    rng = random.Random(4)
    for _ in range(60):
        words = []
        for _ in range(6):
            said = list(rng.choice(NOTICES).phrase)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(said))
                said[at] = rng.choice(["", "x", " ", said[at] + "e"])
            words += ["the", *"".join(said).split()]
        got = scan([w.encode() for w in words])
        for notice in NOTICES:
            near = []
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + 18) + 1):
                    said = " ".join(words[a:b])
                    if abs(len(said) - len(notice.phrase)) <= notice.edits and set(notice.fixed.split()) <= set(words[a:b]):
                        far = full(notice.phrase, said)
                        near += [(far, a, b)] if far <= notice.edits else []
            taken = []
            for far, a, b in sorted(near):
                if not any(p < b and a < q for _, p, q in taken):
                    taken.append((far, a, b))
            assert sorted((m[3], m[1], m[1] + m[2]) for m in got if m[0] == notice.label) == sorted(taken)


def test_edits_are_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        phrase, said = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(2))
        edits = rng.randint(1, 4)
        fuzzy = license_scan._tools((Notice("x", phrase, edits),))[2][0]
        far = full(phrase, said)
        assert [bool(p.fullmatch(said)) for p in fuzzy] == [far <= k for k in range(1, edits + 1)]
    assert license_scan.scan([]) == []


def test_repeated_close_notices_take_time_in_proportion():
    import time

    def seconds(n):
        words = b"undr the mit licence ".split() * n
        start = time.perf_counter()
        assert len(scan(words)) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 14 * max(0.05, seconds(4_000))
