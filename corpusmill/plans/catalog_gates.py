"""Registered queries of the gates over made items, views, windows and facts; they join the catalog's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, gates, item_gates, sampling
from ..operators import item_gates as G
from .catalog import _RUNS, _docs, _items, query
from .derived import ITEMS, MCQ, ROLL, chunks, items, mcq, rollouts, run, sql_byte, sql_h, sql_run


def _sq(pattern: str) -> str:
    """A Java pattern as an RE2 literal: there classes are ASCII's, which the texts they meet don't notice."""
    return pattern.replace("'", "''").replace("(?Ui)", "(?i)").replace("(?U)", "")


_SPACED = r"lower(trim(regexp_replace(regexp_replace({0}, '\[[^\]]*\]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')))"
_WS = r"trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g'))"
_PUNCT = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_ \t\n\r\f\v.\-]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"
_QW = "regexp_extract_all(" + _SPACED + r", '[a-z0-9][a-z0-9.\-]+')"
_KEY = "array_to_string({0}[greatest(1, len({0}) - {1}):], ' ')"
_TERMS = "list_filter(string_split(" + _PUNCT + ", ' '), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in G.SMALL_WORDS) + "], x))"


# Made items.
@query(f"""WITH {ITEMS}, i0 AS (SELECT items.*, {_QW.format('question')} AS w, {_SPACED.format('chunks.text')} AS src, {_SPACED.format('evidence')} AS ev, list_transform(choices, lambda c: {_SPACED.format('c')}) AS o FROM items LEFT JOIN chunks USING (chunk_id)),
t AS (SELECT item_id, {_QW.format('text')} AS w FROM benchmark), k AS (SELECT array_to_string(w, ' ') AS key FROM t UNION SELECT {_KEY.format('w', 7)} FROM t WHERE len(w) >= 8),
i1 AS (SELECT *, {_KEY.format('w', 5)} AS tail, (array_to_string(w, ' ') IN (SELECT key FROM k) OR (len(w) >= 8 AND {_KEY.format('w', 7)} IN (SELECT key FROM k))) AS copied,
  CASE WHEN len(list_filter(choices, lambda c: trim(c) = '')) > 0 OR len(choices) NOT BETWEEN 4 AND 5 OR trim(evidence) = '' OR len(list_distinct(o)) <> len(o) THEN 'schema'
       WHEN regexp_matches(question, '{_sq(G.STYLE)}') OR len(w) < 5 OR NOT contains(question, 'Release') THEN 'style' WHEN NOT contains(coalesce(src, ''), ev) THEN 'grounded' END AS r FROM i0),
f AS (SELECT tail, min(item_id) AS first FROM i1 WHERE r IS NULL AND NOT copied GROUP BY 1),
i2 AS (SELECT i1.*, coalesce(r, CASE WHEN item_id > first THEN 'dedup' WHEN copied THEN 'contamination' END) AS reason FROM i1 LEFT JOIN f USING (tail)),
near AS (SELECT DISTINCT i2.item_id FROM i2, t WHERE reason IS NULL AND len(list_intersect(i2.w, t.w)) >= 0.6 * len(list_distinct(list_concat(i2.w, t.w))))
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM i2 GROUP BY 1 UNION ALL SELECT 'near_test', count(*) FROM near HAVING count(*) > 0""")
def g02_synthetic_gate(s, d):
    out = G.synthetic(items(s, d), chunks(s, d), _items(s, d))
    return gates.report(out).unionByName(out.where("near_test").groupBy(F.lit("near_test").alias("reason")).agg(F.count("*").alias("n")))


@query(f"""WITH {ITEMS}, i0 AS (SELECT items.*, {_WS.format('coalesce(evidence, chr(32))')} AS e, {_WS.format('coalesce(answer, chr(32))')} AS a, lower({_WS.format('question')}) AS q, coalesce({_WS.format('chunks.text')}, '') AS src,
  list_transform(distractors, lambda x: lower({_WS.format('x')})) AS dl FROM items LEFT JOIN chunks USING (chunk_id)), f AS (SELECT q, min(item_id) AS first FROM i0 GROUP BY 1),
r AS (SELECT i0.*, list_filter([CASE WHEN e = '' OR a = '' OR q = '' THEN 'empty_field' END, CASE WHEN e <> '' AND src <> '' AND NOT contains(src, e) THEN 'evidence_not_verbatim' END, CASE WHEN e <> '' AND src = '' THEN 'chunk_missing' END,
  CASE WHEN a <> '' AND e <> '' AND NOT contains(lower(e), lower(a)) THEN 'answer_not_in_evidence' END, CASE WHEN len(list_filter(string_split(a, ' '), lambda x: x <> '')) > 12 THEN 'answer_too_long' END, CASE WHEN len(dl) <> 3 THEN 'distractor_count' END,
  CASE WHEN len(dl) = 3 AND len(list_distinct(dl)) <> 3 THEN 'distractors_duplicated' END, CASE WHEN len(dl) = 3 AND len(list_distinct(dl)) = 3 AND list_contains(dl, lower(a)) THEN 'distractor_equals_answer' END,
  CASE WHEN len(why_wrong) <> len(dl) THEN 'why_wrong_count' END, CASE WHEN item_id > first THEN 'duplicate_question' END], lambda x: x IS NOT NULL) AS reasons FROM i0 JOIN f USING (q))
SELECT item_id, array_to_string(reasons, ',') AS reasons, len(list_filter(reasons, lambda x: x <> 'answer_not_in_evidence')) = 0 AS kept FROM r""")
def g03_static_gate(s, d):
    return G.static(items(s, d), chunks(s, d)).select("item_id", F.array_join("reasons", ",").alias("reasons"), "kept")


@query(f"""WITH {ITEMS}, i0 AS (SELECT items.*, list_distinct({_TERMS.format('answer')}) AS a, {_TERMS.format('evidence')} AS e, {_TERMS.format('question')} AS q, {_QW.format('question')} AS w, {_PUNCT.format('chunks.text')} AS src FROM items LEFT JOIN chunks USING (chunk_id)),
t AS (SELECT {_KEY.format('w', 5)} AS tail FROM (SELECT {_QW.format('text')} AS w FROM benchmark)),
i1 AS (SELECT *, {_KEY.format('w', 5)} AS tail, CASE WHEN src IS NULL THEN 'no_chunk' WHEN NOT contains(src, {_PUNCT.format('evidence')}) THEN 'evidence_not_verbatim' WHEN len(a) > 0 AND len(list_intersect(a, e)) = 0 THEN 'answer_not_in_evidence'
  WHEN len(a) > 0 AND len(list_filter(a, lambda x: NOT list_contains(q, x))) = 0 THEN 'tautology' WHEN regexp_matches(question, '{_sq(G.BOILERPLATE)}') OR regexp_matches(evidence, '{_sq(G.BOILERPLATE)}') THEN 'document_boilerplate'
  WHEN regexp_matches(evidence, '{G.CONTENTS}') THEN 'toc_evidence' WHEN {_KEY.format('w', 5)} IN (SELECT tail FROM t) THEN 'TEST_OVERLAP' END AS r FROM i0),
f AS (SELECT tail, min(item_id) AS first FROM i1 WHERE r IS NULL GROUP BY 1) SELECT item_id, coalesce(r, CASE WHEN item_id > first THEN 'dup' END, 'kept') AS reason FROM i1 LEFT JOIN f USING (tail)""")
def g04_grounded_gate(s, d):
    return G.grounded(items(s, d), chunks(s, d), _items(s, d)).select("item_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"""WITH {MCQ}, {ROLL}, {sql_run('base')}, a AS (SELECT sample_id, 'context' AS mode, choices[answer + 1] AS gold, 'It is: ' || choices[predicted + 1] || '!' AS said FROM base
  UNION ALL SELECT sample_id, CASE WHEN k < 4 THEN 'nothink' ELSE 'think' END, choices[roll.answer + 1], choices[predicted + 1] FROM roll JOIN mcq USING (sample_id)),
m AS (SELECT *, contains({_PUNCT.format('said')}, {_PUNCT.format('gold')}) AS inside, {_TERMS.format('said')} AS p, {_TERMS.format('gold')} AS g FROM a),
h AS (SELECT sample_id, mode, inside OR (len(p) + len(g) > 0 AND 2 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda u: u = t)), len(list_filter(g, lambda u: u = t))))), 0) / (len(p) + len(g)) >= 0.5) AS hit FROM m),
c AS (SELECT sample_id, count(*) FILTER (mode = 'context' AND hit) AS c, count(*) FILTER (mode = 'nothink' AND hit) AS n, count(*) FILTER (mode = 'think' AND hit) AS t FROM h GROUP BY 1)
SELECT sample_id, CASE WHEN c = 0 THEN 'not_answerable_with_context' WHEN n > 0 THEN 'known_closed_book_nothink' WHEN t > 0 THEN 'known_closed_book_thinking' ELSE 'kept' END AS reason FROM c""")
def g05_answerable_gate(s, d):
    option = lambda c: F.col("choices")[F.col(c)]
    own = run(s, d, "base").select("sample_id", F.lit("context").alias("mode"), option("answer").alias("gold"), F.concat(F.lit("It is: "), option("predicted"), F.lit("!")).alias("said"))
    texts = mcq(s, d).select("sample_id", "choices")
    rolls = rollouts(s, d).join(texts, "sample_id").select("sample_id", F.when(F.col("k") < 4, "nothink").otherwise("think").alias("mode"), option("answer").alias("gold"), option("predicted").alias("said"))
    out = G.answerable(G.says(own.unionByName(rolls), "said", "gold", "hit"), "sample_id")
    return out.select("sample_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE NOT regexp_matches(question, '{_sq(G.STYLE)}') AND NOT regexp_matches(question, '{_sq(G.BOILERPLATE)}')")
def g06_style_drops(s, d):
    q = F.col("question")
    return items(s, d).where(~q.rlike(G.STYLE) & ~q.rlike(G.BOILERPLATE)).select("item_id")


@query(f"WITH {_RUNS} SELECT sample_id FROM base WHERE {sql_h(chr(39) + 'keep' + chr(39), 'sample_id')} < CASE WHEN parse_failed THEN 0.5 WHEN correct THEN 0.2 ELSE 0.9 END")
def g07_difficulty_keep(s, d):
    r = run(s, d, "base")
    weights = F.create_map(*[F.lit(x) for kv in (("unparsed", 0.5), ("right", 0.2), ("wrong", 0.9)) for x in kv])
    mode = F.when(F.col("parse_failed"), "unparsed").when(F.col("correct"), "right").otherwise("wrong")
    return sampling.weighted_keep(r, "sample_id", weights[mode], "keep").select("sample_id")


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9.\-]{{2,}}'))"


@query(f"""WITH {MCQ}, p0 AS (SELECT sample_id, choices[answer + 1] AS gold, choices, unnest(range(1, 11)) AS i FROM mcq),
p AS (SELECT sample_id, gold, i, CASE i WHEN 1 THEN ' ' WHEN 2 THEN upper(gold) WHEN 3 THEN array_to_string(list_reverse(string_split(gold, ' ')), ' ') WHEN 8 THEN choices[1] WHEN 9 THEN repeat('long ', 30) WHEN 10 THEN repeat('long ', 30) ELSE choices[i - 3] END AS x FROM p0),
q AS (SELECT *, lower(trim(x)) AS key, {_TOK.format('x')} AS tx, {_TOK.format('gold')} AS tg FROM p),
r AS (SELECT *, CASE WHEN key = '' THEN 'empty' WHEN key = lower(trim(gold)) THEN 'equals_answer' WHEN CASE WHEN len(tx) + len(tg) = 0 THEN 1 ELSE len(list_intersect(tx, tg)) / len(list_distinct(list_concat(tx, tg))) END >= 0.75 THEN 'paraphrase_of_answer'
  WHEN len(list_filter(string_split(trim(x), ' '), lambda w: w <> '')) > 3 * greatest(len(string_split(gold, ' ')), 4) THEN 'too_long' END AS own FROM q),
o AS (SELECT *, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY sample_id, key, own ORDER BY i) > 1 THEN 'duplicate' END) AS reason FROM r)
SELECT sample_id, array_to_string(list(coalesce(reason, 'ok') ORDER BY i), ',') AS reasons, coalesce(array_to_string((list(x ORDER BY i) FILTER (reason IS NULL))[1:3], '|'), '') AS kept FROM o GROUP BY 1""")
def g08_hard_negatives(s, d):
    q = mcq(s, d).withColumn("gold", F.col("choices")[F.col("answer")])
    reverse = F.array_join(F.reverse(F.split("gold", " ")), " ")
    long = F.lit("long " * 30)
    q = q.withColumn("proposals", F.concat(F.array(F.lit(" "), F.upper("gold"), reverse), "choices", F.array(F.col("choices")[0], long, long)))
    out = G.hard_negatives(q.select("sample_id", "gold", "proposals"), on="sample_id")
    return out.select("sample_id", F.array_join(F.transform("judged", lambda x: F.coalesce(x["reason"], F.lit("ok"))), ",").alias("reasons"), F.array_join("kept", "|").alias("kept"))


# Views of chunks.
_SRC = f"v AS (SELECT items.*, coalesce(lower({_WS.format('chunks.text')}), '') AS src FROM items LEFT JOIN chunks USING (chunk_id))"
_LOW = "lower(" + _WS + ")"


def _views(s, d):
    src = chunks(s, d).select("chunk_id", T.norm_ws_lower(F.col("text")).alias("source"))
    return items(s, d).join(src, "chunk_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def _choice_sql(least: int) -> str:
    return f"len(choices) BETWEEN {least} AND 5 AND len(list_filter(choices, lambda c: trim(c) = '')) = 0 AND len(list_distinct(list_transform(choices, lambda c: {_LOW.format('c')}))) = len(choices) AND contains(src, substr({_LOW.format('evidence')}, 1, 80))"


@query(f"""WITH {ITEMS}, {_SRC} SELECT item_id, length(answer) BETWEEN 2 AND 80 AND contains(src, {_LOW.format('answer')}) AND NOT contains({_LOW.format('question')}, {_LOW.format('answer')}) AS facts,
contains(src, {_LOW.format('answer')}) AS qa, {_choice_sql(4)} AS mcq FROM v""")
def g10_view_gates(s, d):
    v, src = _views(s, d), F.col("source")
    return v.select("item_id", G.facts_ok(F.col("answer"), F.col("question"), src).alias("facts"), G.verbatim(F.col("answer"), src).alias("qa"), G.choice_ok(F.col("choices"), F.col("gold"), F.col("evidence"), src).alias("mcq"))


@query(f"""WITH {ITEMS}, l AS (SELECT item_id, answer, unnest([question, '1. ' || question, '2) ' || evidence, 'short', evidence]) AS line, unnest(range(5)) AS i FROM items),
m AS (SELECT *, trim(regexp_replace(line, '^[ ]*[0-9]+[.)][ ]*', '')) AS t FROM l), n AS (SELECT *, {_LOW.format('t')} AS k FROM m WHERE length(t) >= 20)
SELECT item_id, i, contains(k, {_LOW.format('answer')}) AS ok FROM n QUALIFY row_number() OVER (PARTITION BY item_id, k ORDER BY i) = 1""")
def g10_fact_views(s, d):
    """Lines that state a fact, without their numbers: long ones, each once for a fact, good if they have the answer."""
    q, e = F.col("question"), F.col("evidence")
    lines = F.array(q, F.concat(F.lit("1. "), q), F.concat(F.lit("2) "), e), F.lit("short"), e)
    v = items(s, d).select("item_id", "answer", F.posexplode(lines).alias("i", "line"))
    return item_gates.fact_lines(v, "item_id", "i", "line", "answer").select("item_id", F.col("i").cast("long").alias("i"), "ok")


@query(f"""WITH {ITEMS}, {_SRC}, r AS (SELECT *, CASE WHEN src = '' THEN 'bad' WHEN len(choices) NOT BETWEEN 3 AND 5 OR len(list_filter(choices, lambda c: trim(c) = '')) > 0 THEN 'bad' WHEN len(list_distinct(list_transform(choices, lambda c: {_LOW.format('c')}))) <> len(choices) THEN 'dup-opt'
  WHEN len(list_filter(choices, lambda c: NOT contains(src, {_LOW.format('c')}))) > 0 THEN 'opt-not-verbatim' WHEN NOT contains(src, substr({_LOW.format('evidence')}, 1, 80)) THEN 'ev-not-verbatim' ELSE 'kept' END AS reason FROM v WHERE src <> '')
SELECT item_id, reason FROM r""")
def g11_sibling_gate(s, d):
    return G.sibling(_views(s, d).where("source <> ''")).select("item_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


def _het_sql(style: str) -> str:
    more = "WHEN NOT contains(question, '____') THEN 'no-blank'" if style == "cloze" else "WHEN NOT regexp_matches(answer, '[0-9]') THEN 'not-numeric'" if style == "numeric" else ""
    n = "len(list_filter(string_split(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), lambda x: x <> ''))"
    found = "regexp_extract_all({0}, '[a-z0-9][a-z0-9.\\-]{{3,}}')"
    return f"""WITH {ITEMS}, {_SRC}, h0 AS (SELECT *, {_LOW.format('answer')} AS a, item_id // 10 AS win, CASE WHEN {n.format('question')} NOT BETWEEN 3 AND 45 OR {n.format('answer')} NOT BETWEEN 1 AND 10 THEN 'bad' WHEN regexp_matches(question, '{_sq(G.META)}') THEN 'context-dep'
  WHEN NOT contains(src, {_LOW.format('answer')}) THEN 'ans-not-verbatim' {more} WHEN len(list_filter({found.format(_LOW.format('question'))}, lambda x: list_contains({found.format('src')}, x))) < 2 THEN 'no-entity' END AS r FROM v),
f AS (SELECT win, a, min(item_id) AS first FROM h0 WHERE r IS NULL GROUP BY ALL) SELECT h0.item_id, coalesce(r, CASE WHEN h0.item_id > first THEN 'dup-answer' END, 'kept') AS reason FROM h0 LEFT JOIN f ON f.win = h0.win AND f.a = h0.a"""


def _het(s, d, style):
    v = _views(s, d).withColumn("win", F.floor(F.col("item_id") / 10))
    return G.het(v, style, "item_id", "win").select("item_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(_het_sql("entity"))
def g11_het_gate(s, d):
    return _het(s, d, "entity")


@query(_het_sql("numeric"))
def g11_numeric_gate(s, d):
    return _het(s, d, "numeric")


@query(_het_sql("cloze"))
def g11_cloze_gate(s, d):
    return _het(s, d, "cloze")


@query(f"""WITH {ITEMS}, c0 AS (SELECT *, list_transform(choices, lambda c: trim(c)) AS o, CAST(floor({sql_h("'turn'", 'CAST(item_id AS VARCHAR)')} * len(choices)) AS INTEGER) AS want FROM items),
c1 AS (SELECT *, CASE WHEN len(list_distinct(list_transform(o, lambda c: lower(c)))) < len(o) THEN 'duplicate options' WHEN regexp_matches(question, '{_sq(G.META)}') OR len(list_filter(o, lambda c: regexp_matches(c, '{_sq(G.META)}'))) > 0 THEN 'refers to the passage' WHEN len(o) NOT BETWEEN 3 AND 5 THEN 'bad option count' ELSE 'kept' END AS reason FROM c0)
SELECT item_id, reason, want AS gold, array_to_string(list_transform(range(len(o)), lambda i: o[(i - (want - gold) + 2 * len(o)) % len(o) + 1]), '|') AS choices FROM c1""")
def g12_synthetic_clean(s, d):
    rows = items(s, d).withColumn("id", F.col("item_id").cast("string"))
    out = G.cleaned(rows, "turn")
    return out.select("item_id", F.coalesce("reason", F.lit("kept")).alias("reason"), "gold", F.array_join("choices", "|").alias("choices"))


@query(f"WITH {_RUNS} SELECT CASE WHEN b.letter <> chr(65 + a.answer) THEN 'discard' WHEN a.letter <> chr(65 + a.answer) THEN 'teaches' ELSE 'anchor' END AS tier, count(*) AS n FROM base a JOIN armx b USING (sample_id) GROUP BY 1")
def g12_tiers(s, d):
    j = run(s, d, "base").join(run(s, d, "armx").select("sample_id", F.col("letter").alias("with_context")), "sample_id")
    return j.groupBy(G.tier(F.col("letter"), F.col("with_context"), T.letter(F.col("answer"))).alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {_RUNS} SELECT CASE WHEN letter = '' THEN 'unparsed' WHEN {sql_h(chr(39) + 'stop' + chr(39), 'sample_id')} < 0.1 THEN 'truncated' WHEN letter <> chr(65 + answer) THEN 'wrong' ELSE 'kept' END AS reason, count(*) AS n FROM base GROUP BY 1")
def g13_replay_keep(s, d):
    return gates.report(G.replay(run(s, d, "base"), F.col("letter"), T.h01("stop", F.col("sample_id")) >= 0.1, T.letter(F.col("answer"))))


# Windows by what their letters say: the rollouts of a question stand for its windows.
_SINGLE = f"{MCQ}, {ROLL}, {sql_run('base')}, single AS (SELECT sample_id, CAST(k AS VARCHAR) || '-' || substr(sample_id, 6, 2) AS win_id, k, CASE WHEN k = 7 THEN '' ELSE chr(65 + predicted) END AS letter FROM roll), b AS (SELECT sample_id, letter AS bl, chr(65 + answer) AS g FROM base)"


def _single(s, d):
    win = F.concat(F.col("k").cast("string"), F.lit("-"), F.substring("sample_id", 6, 2))
    return rollouts(s, d).select("sample_id", win.alias("win_id"), "k", F.when(F.col("k") == 7, "").otherwise(T.letter(F.col("predicted"))).alias("letter"))


@query(f"WITH {_SINGLE} SELECT win_id, count(*) AS n_q, count(*) FILTER (letter <> bl) AS n_change FROM single JOIN b USING (sample_id) GROUP BY 1 HAVING count(*) FILTER (letter <> bl) > 0")
def g14_moving_windows(s, d):
    return G.moving_windows(_single(s, d), run(s, d, "base"))


@query(f"""WITH {_SINGLE}, c AS (SELECT sample_id, letter, count(*) AS n, min(k) AS f FROM single WHERE letter <> '' GROUP BY ALL), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, f) = 1)
SELECT DISTINCT win_id FROM single JOIN m USING (sample_id) JOIN b USING (sample_id) WHERE single.letter <> '' AND single.letter = m.letter AND single.letter <> bl""")
def g14_agreeing_windows(s, d):
    return G.agreeing_windows(_single(s, d), run(s, d, "base"), "k")


@query(f"WITH {_SINGLE} SELECT DISTINCT win_id FROM single JOIN b USING (sample_id) WHERE bl <> g AND letter = g")
def g15_curing_windows(s, d):
    return G.curing_windows(_single(s, d), run(s, d, "base"), mcq(s, d).select("sample_id", T.letter(F.col("answer")).alias("letter")))


@query(f"""WITH c AS (SELECT doc_id, source, {_WS.format('text')} AS t, text FROM documents) SELECT CASE WHEN source = 'src3' THEN 'excluded' WHEN regexp_matches(substr(text, 1, 40), '{_sq(chunking.FRONT_MATTER)}') OR substr(text, 1, 2) = 'Th' THEN 'front_matter'
  WHEN len(list_filter(string_split(t, ' '), lambda x: x <> '')) < 40 THEN 'too_short' ELSE 'kept' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def g16_chunk_gate(s, d):
    """The first 40 characters stand for a chunk's headings; those that begin with Th are given one of front matter."""
    head = F.substring("text", 1, 40)
    rows = _docs(s, d).select("doc_id", F.col("source").alias("series"), "text", F.when(F.col("text").startswith("Th"), F.concat(F.lit("Foreword "), head)).otherwise(head).alias("headings"))
    return gates.report(chunking.chunk_gate(rows, ["src3"]))


@query(f"""WITH {ITEMS}, {_SRC}, a AS (SELECT *, list_filter(list_distinct(regexp_extract_all(regexp_replace(evidence, '[^ -~]', '', 'g') || CASE WHEN way < 8 THEN ' for 25 ms in TS 23.501 and ABCD' ELSE '' END, '{_sq(G.ATOM)}')), lambda x: length(x) >= 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in G.ATOM_STOP)}], lower(x))) AS atoms FROM v)
SELECT item_id, len(atoms) AS atoms, len(atoms) = 0 OR len(list_filter(atoms, lambda x: contains(src, {_LOW.format('x')}))) >= 0.7 * len(atoms) AS kept FROM a""")
def g17_atoms_gate(s, d):
    more = F.when(F.col("way") < 8, " for 25 ms in TS 23.501 and ABCD").otherwise("")
    v = _views(s, d).withColumn("said", F.concat(F.regexp_replace("evidence", "[^ -~]", ""), more))
    return v.select("item_id", F.size(G.atoms(F.col("said"))).cast("long").alias("atoms"), G.atoms_kept(F.col("said"), F.col("source")).alias("kept"))


@query(f"WITH {_RUNS}, g AS (SELECT round(count(*) FILTER (b.correct) / count(*), 6) AS accuracy, round(count(*) FILTER (a.correct) / count(*), 6) AS reference FROM base a JOIN armx b USING (sample_id)) SELECT accuracy, reference, accuracy >= reference + 0.01 AND accuracy >= 0.5 AS passed FROM g")
def g18_pipeline_gate(s, d):
    j = run(s, d, "base").select("sample_id", F.col("correct").alias("a")).join(run(s, d, "armx").select("sample_id", F.col("correct").alias("b")), "sample_id")
    g = j.agg(F.round(F.count_if("b") / F.count("*"), 6).alias("accuracy"), F.round(F.count_if("a") / F.count("*"), 6).alias("reference"))
    return g.withColumn("passed", (F.col("accuracy") >= F.col("reference") + 0.01) & (F.col("accuracy") >= 0.5))


@query(f"""WITH {ITEMS}, {_SRC}, b0 AS (SELECT item_id, src, way % 4 AS kind_no, evidence, CASE way % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'one' WHEN 2 THEN 'not' ELSE 'all' END AS kind, CASE WHEN way % 4 = 1 THEN [answer] ELSE [answer, answer || ' a', answer || ' b'] END AS t,
  CASE WHEN way % 4 = 0 THEN [] WHEN way % 8 = 2 THEN ['never said so', 'nor this'] WHEN way % 4 = 3 THEN [' '] ELSE ['never said so', evidence] END AS f, [evidence, evidence, evidence] AS ev, CASE WHEN way % 4 = 2 THEN 'Which of these is NOT the case?' ELSE 'Which of these is the case?' END AS q FROM v),
b1 AS (SELECT *, length({_LOW.format('evidence')}) >= 30 AND contains(src, substr({_LOW.format('evidence')}, 1, 80)) AS held FROM b0)
SELECT item_id, CASE WHEN len(list_filter(list_concat(t, f), lambda x: trim(x) = '')) > 0 THEN 'bad' WHEN kind = 'all' AND held THEN 'all' WHEN kind = 'one' AND held AND len(list_filter(f, lambda x: contains(src, substr({_LOW.format('x')}, 1, 60)))) = 0 THEN 'one'
  WHEN kind = 'not' AND held AND NOT contains(src, substr({_LOW.format('f[1]')}, 1, 60)) THEN 'not' ELSE 'gated' END AS verdict FROM b1""")
def g19_behaviour_gate(s, d):
    k, a, e, way = F.col("way") % 4, F.col("answer"), F.col("evidence"), F.col("way")
    true = F.when(k == 1, F.array(a)).otherwise(F.array(a, F.concat(a, F.lit(" a")), F.concat(a, F.lit(" b"))))
    false = F.when(k == 0, F.array().cast("array<string>")).when(way % 8 == 2, F.array(F.lit("never said so"), F.lit("nor this"))).when(k == 3, F.array(F.lit(" "))).otherwise(F.array(F.lit("never said so"), e))
    kind = F.when(k == 1, "one").when(k == 2, "not").otherwise("all")
    q = F.when(k == 2, "Which of these is NOT the case?").otherwise("Which of these is the case?")
    rows = _views(s, d).select("item_id", "source", kind.alias("kind"), true.alias("true"), false.alias("false"), F.array(e, e, e).alias("evidence"), q.alias("q"))
    return G.behaviour(rows).select("item_id", "verdict")


@query(f"""WITH {_RUNS}, j AS (SELECT a.sample_id, a.choices[a.predicted + 1] AS ta, b.choices[b.predicted + 1] AS tb, a.letter AS la, b.letter AS lb, c.letter AS lc FROM base a JOIN armx b USING (sample_id) JOIN army c USING (sample_id)),
t AS (SELECT *, list_distinct(string_split(lower(ta), ' ')) AS x, list_distinct(string_split(lower(tb), ' ')) AS y FROM j)
SELECT sample_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.5 AS texts_agree, la <> '' AND la = lb AND lb = lc AS teachers_agree FROM t""")
def g20_agreement_gates(s, d):
    text = lambda: F.split(F.lower(F.col("choices")[F.col("predicted")]), " ")
    a = run(s, d, "base").select("sample_id", text().alias("x"), F.col("letter").alias("la"))
    b = run(s, d, "armx").select("sample_id", text().alias("y"), F.col("letter").alias("lb"))
    c = run(s, d, "army").select("sample_id", F.col("letter").alias("lc"))
    j = a.join(b, "sample_id").join(c, "sample_id")
    return j.select("sample_id", (T.jaccard(F.col("x"), F.col("y")) >= 0.5).alias("texts_agree"), F.coalesce((F.col("la") != "") & (F.size(F.array_distinct(F.array("la", "lb", "lc"))) == 1), F.lit(False)).alias("teachers_agree"))


@query(f"""WITH {_RUNS}, w AS (SELECT a.sample_id, a.answer, b.letter AS rt, {sql_byte("'fact|' || a.sample_id")} % 8 AS way, a.choices[a.answer + 1] AS g FROM base a JOIN armx b USING (sample_id)),
f AS (SELECT *, CASE way WHEN 0 THEN '' WHEN 1 THEN 'As stated, it is ' || g WHEN 2 THEN 'The answer does not mention it' ELSE 'It is ' || g || '.' END AS fact, CASE way WHEN 0 THEN 'empty' WHEN 1 THEN 'meta' ELSE '' END AS flag FROM w)
SELECT sample_id, fact, CASE WHEN flag <> '' THEN flag WHEN way = 2 THEN 'self-refuting' WHEN rt <> chr(65 + answer) THEN 'no round trip' ELSE 'kept' END AS reason FROM f""")
def g21_fact_gate(s, d):
    way, g = T.sha_byte(F.concat(F.lit("fact|"), "sample_id")) % 8, F.col("choices")[F.col("answer")]
    said = F.when(way == 0, "<|channel>thought").when(way == 1, F.concat(F.lit('"As  stated, it is '), g, F.lit('"'))).when(way == 2, "The answer <b>does not\nmention it").otherwise(F.concat(F.lit("<i>It is "), g, F.lit(".</i><channel|>done")))
    r = run(s, d, "base").withColumn("said", said).join(run(s, d, "armx").select("sample_id", F.col("letter").alias("rt")), "sample_id")
    fact, flag = G.fact_flag(F.col("said"))
    r = r.withColumn("fact", fact).withColumn("flag", flag)
    rules = [("empty", F.col("flag") == "empty"), ("meta", F.col("flag") == "meta"), ("self-refuting", F.col("fact").rlike(G.NO_EVIDENCE)), ("no round trip", F.col("rt") != T.letter(F.col("answer")))]
    return gates.first_reason(r, rules).select("sample_id", "fact", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"WITH {_RUNS} SELECT sample_id FROM base WHERE subject IN ('ECONOMY', 'STANDARD') AND NOT parse_failed ORDER BY sample_id LIMIT 50")
def g01_simple_filter(s, d):
    return run(s, d, "base").where(F.col("subject").isin("ECONOMY", "STANDARD") & ~F.col("parse_failed")).orderBy("sample_id").limit(50).select("sample_id")
