"""Operators on an awkward small table, against brute force; empty tables; clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import budget_mix, chat_windows, crf_pii, ctw, decision_rules, decontaminate, license_scan, line_windows, probminhash, pu_quality
from tests.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return common.frame(spark)


@pytest.fixture(scope="module")
def rows():
    return common.rows()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_decision_rules(spark, docs, rows, labels):
    rules = decision_rules.fit(docs, labels)
    out = decision_rules.judge(docs, rules).collect()
    assert len(out) == len(rows) and "n_lines" in out[0] and out[0].kept in (True, False)
    for r in out:
        n = len(WORD.findall(r.text or ""))
        assert r._stats.n_words == n and (n >= 10 or (r.base_failed and not r.kept))
    assert decision_rules.fit(docs, labels.limit(0)) == []
    assert decision_rules.judge(common.empty(spark), rules).count() == 0
    # the expression says what the rules say
    rule = decision_rules.Rule((("n_words", True, 20.0), ("word_len", False, 3.0)), False, 1, 0)
    stats = decision_rules.with_statistics(docs).withColumn("k", decision_rules.as_column([rule]))
    for r in stats.collect():
        assert r.k == (not (r._stats.n_words > 20 and r._stats.word_len <= 3.0))


def test_pu_quality(spark, docs, rows, labels):
    model = pu_quality.fit(docs, labels)
    out = pu_quality.score(docs, model, "s").collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    none = pu_quality.fit(common.empty(spark), labels.limit(0))
    assert pu_quality.score(docs, none, "s").count() == len(rows)
    assert pu_quality.score(common.empty(spark), model).count() == 0


def test_personal_data(spark, docs, rows):
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("é mail to ab.1@mail2.example.com, +1 (314) 555-6532 4111111111111111 or 10.1.2.3 é")))
    field = crf_pii.fit(crf_pii.labelled_lines(more), rounds=20)
    out = crf_pii.find(more, field).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        base = [(s.kind, s.start, s.end) for s in r._pii.spans if s.base]
        assert base == crf_pii.base_spans(r.text or "")
    assert crf_pii.find(common.empty(spark), field).count() == 0
    assert len(crf_pii.labelled_lines(common.empty(spark))) == sum(n for _, n in crf_pii.MARKED)


def test_notices(spark, docs, rows):
    out = license_scan.find_notices(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        assert r._notices.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    assert license_scan.find_notices(common.empty(spark)).count() == 0


def brute_lines(rows):
    key = sorted({(r.doc_id is None, r.doc_id, r.text) for r in rows if r.text is not None}, key=lambda k: (k[0], k[1] or 0))
    first, gone = {}, defaultdict(set)
    for k in key:
        full = [(i, line.strip(" \t\n\r\x0b\x0c")) for i, line in enumerate(k[2].split("\n"))]
        full = [x for x in full if x[1]]
        for a in range(len(full) - 2):
            w = tuple(x[1] for x in full[a : a + 3])
            if first.setdefault(w, (k, a)) != (k, a):
                gone[k] |= set(range(full[a][0], full[a + 2][0] + 1))
    return gone


def test_line_windows(spark, docs, rows):
    out = line_windows.remove_repeated(docs).collect()
    assert len(out) == len(rows)
    # texts of one doc_id order by hash; this table has one such doc_id, without common windows
    gone = brute_lines(rows)
    want = Counter()
    for r in rows:
        k = (r.doc_id is None, r.doc_id, r.text)
        lines = (r.text or "").split("\n")
        want[(r.doc_id, None if r.text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[k]), 0 if r.text is None else len(lines), len(gone[k]))] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out) == want
    assert any(r.n_removed for r in out) and "score" in out[0]
    assert line_windows.remove_repeated(common.empty(spark)).count() == 0


def brute_classes(rows):
    texts = sorted({r.text or "" for r in rows})
    shingles = []
    for t in texts:
        w = t.split()
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if shingles[i] and shingles[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts) if shingles[i]}
    least = {}
    for r in rows:
        c = of.get(r.text or "")
        if c is not None and r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return [(r.doc_id, r.doc_id if (r.text or "") not in of else least.get(of[r.text or ""])) for r in rows]


def near_rows():
    rng = common.random.Random(8)
    rows = common.rows()
    original = common.sentence(rng, 150).split()
    for i in range(90):  # copies of one original, each nearer to it than to each other
        words = list(original)
        for k in rng.sample(range(150), 1 + i % 6):  # those with many edits are near to none
            words[k] = f"edit{i}x{k}"
        rows.append(common.Row(100 + i, " ".join(words), None, None, None, *"abcdefgh"))
    rows.append(common.Row(99, " ".join(original), None, None, None, *"abcdefgh"))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    docs = common.frame(spark, rows)
    got = probminhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(brute_classes(rows))
    left = probminhash.one_of_each(docs).collect()
    wordless = sum(not (r.text or "").split() for r in rows)
    want = {(c if c is not None else ("none", d)) for (d, c), r in zip(brute_classes(rows), rows, strict=True) if (r.text or "").split()}
    # doc_id 7 names two texts, so two classes have its number
    assert len(left) == len(want) + 1 + wordless and "key" not in left[0].asDict() and "class_id" in left[0].asDict()
    assert probminhash.near_duplicates(common.empty(spark)).count() == 0 and probminhash.one_of_each(common.empty(spark)).count() == 0


def test_leaks(spark, docs, rows):
    rng = common.random.Random(9)
    items = [(i, common.sentence(rng, 30)) for i in range(4)] + [(4, None), (5, "ab"), (6, "")]
    edited = items[1][1].split()
    edited[5], edited[17], edited[25] = "changed", "here", "too"
    del edited[11]
    more = [common.Row(200, "in front " + items[0][1] + " behind", None, None, None, *"abcdefgh"),
            common.Row(201, common.sentence(rng, 40) + " " + " ".join(edited).upper(), None, None, None, *"abcdefgh"),
            common.Row(202, " ".join(items[2][1].split()[:12]), None, None, None, *"abcdefgh")]
    more.append(more[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    all_docs = common.frame(spark, rows + more)
    got = decontaminate.leaks(all_docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(200, 0), (201, 1)} and len(got) == 2
    exact = next(r for r in got if r.doc_id == 200)
    assert (exact.score, exact.first_word, exact.end_word) == (1.0, 2, 32)
    assert decontaminate.without_leaks(all_docs, bench).count() == len(rows) + 1
    assert decontaminate.leaks(common.empty(spark), bench).count() == 0
    assert decontaminate.leaks(all_docs, bench.limit(0)).count() == 0


def test_chat_windows(spark):
    rng = common.random.Random(6)
    turns = []
    for c in range(6):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else ("assistant" if t % 2 else "user")
            turns.append((c, t, role, common.sentence(rng, rng.choice([1, 5, 30, 200]))))
    turns += [(7, 0, None, None), (7, 1, "assistant", ""), (7, 1, "assistant", ""), (None, 0, "user", "<|im_end|>\\"), (None, None, "assistant", "\\n<|im_start|>"), (8, 0, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x"))
    made = chat_windows.windows(df, budget=120, history=40, segment=3)
    windows = made.collect()
    got = {r.conv_id: r for r in chat_windows.digest(made).collect()}
    spans = defaultdict(list)
    for t in turns:
        spans[t[0]].append(t)
    assert set(got) == set(spans)
    for c, some in spans.items():
        some = sorted(some, key=lambda t: (t[1] is not None, t[1] or 0))
        said = [(t[2] or "", t[3] or "") for t in some]
        target = "".join(x for r, x in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
        own = sorted((w for w in windows if w.conv_id == c), key=lambda w: (w.segment, w.window))
        assert r.formatted_chars == sum(len(w.formatted) for w in own)
        for w in own:
            shown = chat_windows.read_turns(w.formatted)
            assert w.n_tokens <= 120 or len(shown) - w.repeated_turns == 1
            if said[0][0] == "system":
                assert shown[0] == said[0]
    assert any(w.segment > 0 and w.repeated_turns > 1 for w in windows)
    assert chat_windows.digest(chat_windows.windows(df.limit(0))).count() == 0


def test_mix(spark, docs, rows):
    out = budget_mix.mix(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert t <= 2 * sizes[s] + 1e-6 and taken[s] <= t + 1e-6
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [target[s] for s in order] == pytest.approx(budget_mix.targets([sizes[s] for s in order], (3, 1, 2), 1.5, 2.0))
    again = budget_mix.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in out)
    assert budget_mix.mix(common.empty(spark)).count() == 0


def test_mix_ranks_over_cuts(spark, monkeypatch):
    """One length holds nearly all documents: many cuts, and still exact counts."""
    monkeypatch.setattr(budget_mix, "CUT", 16)
    docs = spark.range(3000).selectExpr("id as doc_id", "'a b c' as text", "if(id % 3 = 0, 'x', 'y') as source")
    for r in budget_mix.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert 0 <= r.g - r.t < 3


def test_scores(spark, docs, rows):
    learn = F.col("doc_id") % 5 != 1
    out = ctw.score(docs, learn).collect()
    assert len(out) == len(rows)
    low = {r.text: [w.lower() for w in WORD.findall(r.text or "")] for r in rows}
    counts, ends = Counter(), 0
    for r in rows:
        if r.doc_id is not None and r.doc_id % 5 != 1:
            counts.update(low[r.text])
            ends += 1
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(len(low[r.text]) + 1)
    assert all(sorted(by[d]) == sorted(r.n_tokens for r in out if r.doc_id == d) for d in by)
    assert {r.train_tokens for r in out} == {sum(counts.values()) + ends}
    assert all(r.score < 0 and r.base_score < 0 for r in out)
    same = {(r.doc_id, r.score) for r in ctw.score(docs.repartition(5), learn).collect()}
    assert {(d, round(s, 6)) for d, s in same} == {(r.doc_id, round(r.score, 6)) for r in out}
    assert ctw.score(common.empty(spark), learn).count() == 0
    blank = ctw.score(docs.limit(3), F.lit(False)).collect()
    for r in blank:
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        assert r.score == pytest.approx(-(len(text.encode()) + 1) * 8 * 0.30102999566)
