"""One query per operator: its whole table, production parameters, the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import budget_mix, chat_windows, crf_pii, ctw, decision_rules, decontaminate, divergence, importance, license_scan, line_windows
from graphloom.llm import probminhash, pu_quality, url_vocabulary
from graphloom.llm.common import query, remainder, table


@query("op3_decision_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_rules.fit(docs, table(spark, sf_dir, "labels"))
    out = decision_rules.judge(docs, rules)
    counts = [c.split()[0] for c in decision_rules.COUNTS.split(", ")]
    return out.select("doc_id", *[F.col(f"_stats.{c}").alias(c) for c in counts], "base_failed", "kept")


@query("op9_license_notices")
def op9(spark, sf_dir):
    found = license_scan.find_notices(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_notices")
    base = F.filter("_notices.matches", lambda m: m.base)
    words = F.transform(base, lambda m: m.word)

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")

    return found.select(
        "doc_id", F.col("_notices.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("_notices.matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_notices.matches", lambda m: m.similarity)), F.lit(0.0)).alias("score"))


@query("op6_chat_windows")
def op6(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_windows.digest(chat_windows.windows(turns.unionByName(more)))


@query("op8_crf_personal_data")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = crf_pii.fit(crf_pii.labelled_lines(docs))
    found = crf_pii.find(docs, field).select("doc_id", F.col("_pii.spans").alias("_spans"))
    base = F.filter("_spans", lambda s: s.base)

    def count(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


@query("op5_pu_quality")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP2_SQL = r"""with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
full_lines as (select doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as l from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (select doc_id, i as a, l as l1, lead(l) over o as l2, lead(l, 2) over o as l3, lead(i, 2) over o as b from full_lines window o as (partition by doc_id order by i)),
later as (select doc_id, a, b from (select *, row_number() over (partition by l1, l2, l3 order by doc_id, a) as k from w where b is not null) t where k > 1),
gone as (select distinct l.doc_id, l.i from lines l join later r on l.doc_id = r.doc_id and l.i between r.a and r.b),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from lines l anti join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id),
n as (select l.doc_id, count(*) as n_lines, count(g.i) as n_removed from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select n.doc_id, coalesce(k.text, '') as text, n.n_lines, n.n_removed from n left join kept k on n.doc_id = k.doc_id"""


@query("op2_line_windows", OP2_SQL)
def op2(spark, sf_dir):
    return line_windows.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_benchmark_leaks")
def op4(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_th")


@query("op7_probminhash_classes")
def op7(spark, sf_dir):
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op10_budget_mix")
def op10(spark, sf_dir):
    return budget_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op1_context_tree_weighting")
def op1(spark, sf_dir):
    got = ctw.score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return got.select("doc_id", (~F.col("_learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _op11_sql():
    """The same rules and terms, each looked up by a pattern of its own."""
    u = url_vocabulary
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = sorted(u.RULES, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    fits = [f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in rules]
    rule = "case " + " ".join(f"when {f} then '{r.host + r.path}'" for f, r in zip(fits, rules, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, rules, strict=True)) + " end"
    beside = r"[^0-9a-z\x{80}-\x{10FFFF}]"

    def distinct(terms):
        return " + ".join(f"cast(regexp_matches(low, '(^|{beside}){t}($|{beside})', 's') as bigint)" for t in terms)

    return rf"""with a as (select page_id, translate(coalesce(url, ''), '{upper}', '{lower}') as low,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}') as host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
b as (select page_id, host, path, {rule} as rule, {verdict} as said, {distinct(u.STRICT)} as strict_terms, {distinct(u.SOFT)} as soft_terms from a)
select page_id, host, path, rule, coalesce(said, case when strict_terms * {u.LIMIT} + soft_terms * {u.SOFT_WEIGHT} >= {u.LIMIT} then 'block' else 'allow' end) as verdict,
  strict_terms, soft_terms from b"""


@query("op11_url_vocabulary", _op11_sql())
def op11(spark, sf_dir):
    judged = url_vocabulary.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col(f"_url.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "strict_terms", "soft_terms")])


OP12_SQL = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 3),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept k on w.lang = k.lang and w.term = k.term group by all),
f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join kept k on g.lang = k.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
t as (select lang, source, sum(n) as total from f group by lang, source),
p as (select f.lang, f.source, f.term, f.n, 1 + (1000000000::hugeint * (f.n + 1)) // (t.total + v.v) as p
  from f join t on f.lang = t.lang and f.source = t.source join v on v.lang = f.lang),
l as (select lang, term, sum(n) as n from f group by lang, term),
lt as (select lang, sum(n) as total from l group by lang),
q as (select l.lang, l.term, 1 + (1000000000::hugeint * (l.n + 1)) // (lt.total + v.v) as q from l join lt on l.lang = lt.lang join v on v.lang = l.lang),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a
  join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from v)),
terms as (select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q)) // q.q as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
both_parts as (select 'pair' as part, * from pairs union all select 'term', * from terms),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as k from both_parts)
select lang, source, part, item, cast(value as bigint) as value, cast(k as integer) as rank from ranked where part = 'pair' or k <= 200"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_importance_sample")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weighed = importance.weigh(docs, table(spark, sf_dir, "benchmark"))
    drawn = importance.draw(weighed.select("doc_id", "_importance"))
    return drawn.select("doc_id", *[F.col(f"_importance.{c}").alias(c) for c in ("n_features", "weight", "score", "rank")])
