"""More registered queries: analyses of runs and items, gates over rollouts, chunks; they join the catalog's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, contamination, dedup, scoring, voting
from .catalog import _BM25, _EDGES, _ITERMS, _RUNS, _VOTE, _W, _docs, _items, p10_parse_answer, p12_recover_answer, p23_token_f1, query, r01_bm25_top20
from .catalog import ORACLES as _SQL
from .derived import MCQ, ROLL, SAID, completions, mcq, read, rollouts, run, sql_byte, sql_h, sql_run

_A3 = f"{_RUNS}, j AS (SELECT a.sample_id, a.subject, a.answer, a.choices, a.predicted AS pa, b.predicted AS pb, c.predicted AS pc, a.correct AS ca, b.correct AS cb, c.correct AS cc FROM base a JOIN armx b USING (sample_id) JOIN army c USING (sample_id))"


def _three(s, d, *columns):
    return analysis.side_by_side({a: run(s, d, a) for a in ("base", "armx", "army")}, list(columns), keep=("subject", "answer", "choices"))


# Letter probabilities.
_PROBS = f"""{MCQ}, pr0 AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(sha256('p' || CAST(i AS VARCHAR) || '|' || sample_id), 1, 6) AS INTEGER) / 16777216 + CASE WHEN i = answer THEN 0.5::DOUBLE ELSE 0 END) AS raw FROM mcq),
pr1 AS (SELECT *, list_transform(raw, lambda x: round(x / (raw[1] + raw[2] + raw[3] + raw[4]), 6)) AS p FROM pr0),
pr AS (SELECT sample_id, answer, subject, p, p[answer + 1] AS p_gold, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top, round(list_max(p) - list_reverse_sort(p)[2], 6) AS margin, CAST(1 + len(list_filter(p, lambda x: x > p[answer + 1])) AS INTEGER) AS gold_rank FROM pr1)"""


def _probs(s, d):
    draw = "conv(substr(sha2(concat('p', CAST(i AS STRING), '|', sample_id), 256), 1, 6), 16, 10) / 16777216D"
    return analysis.letter_probs(mcq(s, d).withColumn("raw", F.expr(f"transform(sequence(0, 3), i -> {draw} + CASE WHEN i = answer THEN 0.5D ELSE 0D END)")))


@query(f"WITH {_PROBS} SELECT sample_id, top, margin, p_gold, gold_rank FROM pr")
def p34_letter_probs(s, d):
    return _probs(s, d).select("sample_id", "top", "margin", "p_gold", "gold_rank")


@query(f'WITH {_PROBS} SELECT top = answer AS "right", count(*) AS n, count(*) FILTER (margin < 0.2) AS near_tie, count(*) FILTER (margin > 0.8) AS confident, count(*) FILTER (gold_rank = 2 AND margin < 0.1) AS tie_breaker FROM pr GROUP BY 1')
def x29_margin_split(s, d):
    return analysis.margin_split(_probs(s, d))


@query(f"WITH {_PROBS} SELECT sample_id, answer AS chosen, CAST(list_sort(list_transform(list_filter(range(4), lambda i: i <> answer), lambda i: {{'p': -p[i + 1], 'i': i}}))[1].i AS INTEGER) AS rejected FROM pr WHERE p_gold < 0.45")
def v10_probability_pairs(s, d):
    return analysis.probability_pairs(_probs(s, d), 0.45)


@query(f"WITH {_PROBS}, m AS (SELECT subject, {sql_h("'after'", 'sample_id')} - p_gold AS d FROM pr) SELECT subject, count(*) FILTER (d > 0.05) AS up, count(*) FILTER (d < -0.05) AS down, count(*) AS n FROM m GROUP BY 1")
def x17_movement(s, d):
    return scoring.movement(_probs(s, d).withColumn("later", T.h01("after", F.col("sample_id"))), "p_gold", "later", "subject")


# Several systems.
@query(f"""WITH {_RUNS}, t AS (SELECT CAST(unnest([0.3, 0.6, 0.9]) AS DOUBLE) AS tau), c AS (SELECT tau, {sql_h("'conf'", 'a.sample_id')} >= tau AS sure, a.correct AS a, b.correct AS b FROM base a JOIN armx b USING (sample_id), t)
SELECT tau, count(*) AS total, count(*) FILTER (NOT sure) AS deferred, round(count(*) FILTER (CASE WHEN sure THEN a ELSE b END) / count(*), 6) AS accuracy FROM c GROUP BY 1""")
def v06_cascade(s, d):
    return analysis.cascade(run(s, d, "base").withColumn("conf", T.h01("conf", F.col("sample_id"))), run(s, d, "armx"), "conf", [0.3, 0.6, 0.9])


_OK = ", ".join(f"{sql_h(chr(39) + 'ver' + a + chr(39), 'sample_id')} < 0.4 AS o{k}" for a, k in (("base", "a"), ("armx", "b"), ("army", "c")))


@query(f"""WITH {_A3}, v AS (SELECT *, {_OK} FROM j WHERE NOT (pa = pb AND pb = pc)), w AS (SELECT *, CASE WHEN pb = pc THEN pb ELSE pa END AS pl, CAST(oa AS INT) + CAST(ob AS INT) + CAST(oc AS INT) AS k FROM v)
SELECT count(*) AS disputed, count(*) FILTER (pl = answer) AS plurality, count(*) FILTER (CASE WHEN k <> 1 THEN pl WHEN oa THEN pa WHEN ob THEN pb ELSE pc END = answer) AS verified, count(*) FILTER (answer IN (pa, pb, pc)) AS oracle FROM w""")
def v11_adjudication(s, d):
    r = _three(s, d, "predicted")
    return analysis.adjudicated(r.withColumns({f"{a}_ok": T.h01(f"ver{a}", F.col("sample_id")) < 0.4 for a in ("base", "armx", "army")}), ["base", "armx", "army"])


@query(f"""WITH {_A3}, l AS (SELECT *, list_transform(choices, lambda c: length(c)) AS n FROM j), g AS (SELECT count(*) FILTER (NOT ca AND cb) AS gains, count(*) FILTER (NOT ca AND cb AND list_position(n, list_max(n)) - 1 = pb) AS cued FROM l)
SELECT *, round(cued / gains, 6) AS share, CASE WHEN cued / gains >= 0.7 THEN 'artefact' WHEN cued / gains <= 0.3 THEN 'knowledge' ELSE 'mixed' END AS verdict FROM g""")
def x08_gain_attribution(s, d):
    return analysis.attribution(_three(s, d, "predicted", "correct"), F.col("base_correct"), F.col("armx_correct"), T.heuristic_index("choices") == F.col("armx_predicted"))


_PP = "round(100.0 * (count(*) FILTER ({0}) - count(*) FILTER (ca)) / count(*), 4)"


@query(f"WITH {_A3} SELECT {sql_h("'ctx'", 'sample_id')} < 0.6 AS in_context, count(*) AS n, round(count(*) FILTER (ca) / count(*), 6) AS without, round(count(*) FILTER (cb) / count(*), 6) AS given, {_PP.format('cb')} AS given_pp FROM j GROUP BY 1")
def x10_context_delta(s, d):
    r = _three(s, d, "correct").withColumn("in_context", T.h01("ctx", F.col("sample_id")) < 0.6)
    return analysis.rate_table(r, "in_context", {"without": F.col("base_correct"), "given": F.col("armx_correct")}, "without")


@query(f"WITH {_A3} SELECT subject, count(*) AS n, round(count(*) FILTER (ca) / count(*), 6) AS base, round(count(*) FILTER (cc) / count(*), 6) AS shuffled, round(count(*) FILTER (cb) / count(*), 6) AS own, {_PP.format('cc')} AS shuffled_pp, {_PP.format('cb')} AS own_pp FROM j GROUP BY 1")
def x13_ceiling(s, d):
    """Headroom is own_pp, drift of the shuffled control shuffled_pp."""
    return analysis.rate_table(_three(s, d, "correct"), "subject", {"base": F.col("base_correct"), "shuffled": F.col("army_correct"), "own": F.col("armx_correct")}, "base")


@query(f"""WITH {_A3}, u AS (SELECT 'armx' AS rule, pb AS label, pa, answer FROM j UNION ALL SELECT 'army', pc, pa, answer FROM j UNION ALL SELECT 'agreed', CASE WHEN pb = pc THEN pb END, pa, answer FROM j)
SELECT rule, count(*) AS covered, count(*) FILTER (label = answer) AS label_right, count(*) FILTER (pa <> answer AND label = answer) AS fixes, count(*) FILTER (pa = answer AND label <> answer) AS breaks, count(*) FILTER (pa <> answer AND label = answer) - count(*) FILTER (pa = answer AND label <> answer) AS net FROM u WHERE label IS NOT NULL GROUP BY 1""")
def x23_label_rules(s, d):
    x, y = F.col("armx_predicted"), F.col("army_predicted")
    return analysis.label_rules(_three(s, d, "predicted"), {"armx": x, "army": y, "agreed": F.when(x == y, x)}, F.col("base_predicted"), F.col("answer"))


@query(f"WITH {_A3}, g AS (SELECT count(*) FILTER (cb) / count(*) AS l, count(*) FILTER (ca) / count(*) AS o FROM j) SELECT CAST(ob AS DOUBLE) AS obedience, round(CAST(ob AS DOUBLE) * l + (1 - CAST(ob AS DOUBLE)) * o, 6) AS projected FROM g, (SELECT unnest([0.25, 0.5, 1.0]) AS ob)")
def x22_projection(s, d):
    g = _three(s, d, "correct").agg((F.count_if("armx_correct") / F.count("*")).alias("l"), (F.count_if("base_correct") / F.count("*")).alias("o"))
    return analysis.projection(F.col("l"), F.col("o"), g, [0.25, 0.5, 1.0])


@query(f"WITH {_A3} SELECT CASE WHEN pc <> answer AND pa = pc THEN 'obeyed a wrong label' WHEN pc = answer THEN 'not learned' ELSE 'other' END AS class, count(*) AS n FROM j WHERE pa <> answer GROUP BY 1")
def x24_taught_errors(s, d):
    own, label, gold = F.col("base_predicted"), F.col("army_predicted"), F.col("answer")
    c = F.when((label != gold) & (own == label), "obeyed a wrong label").when(label == gold, "not learned").otherwise("other")
    return _three(s, d, "predicted").where(own != gold).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_A3}, u AS (SELECT 'armx' AS arm, pb = pc AS o FROM j UNION ALL SELECT 'base', pa = pc FROM j) SELECT arm, count(*) AS n, count(*) FILTER (o) AS obeyed, round(count(*) FILTER (o) / count(*), 6) AS rate FROM u GROUP BY 1")
def x27_obedience(s, d):
    r = _three(s, d, "predicted").select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), (F.col(f"{a}_predicted") == F.col("army_predicted")).alias("o")) for a in ("armx", "base")])).alias("x")).select("x.*")
    return r.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("o").alias("obeyed")).withColumn("rate", F.round(F.col("obeyed") / F.col("n"), 6))


@query(f"WITH {_A3}, v AS (SELECT *, CASE WHEN pc % 2 = 0 THEN 'VERDICT: none, no: Verdict: ' || chr(65 + pc) ELSE 'it is VERDICT: NONE' END AS said FROM j) SELECT CASE WHEN pc % 2 = 1 THEN 'none' WHEN pc = answer THEN 'gold' WHEN pc = pa THEN 'model' ELSE 'third' END AS class, count(*) AS n FROM v GROUP BY 1")
def x25_verdict_classes(s, d):
    c, gold = F.col("army_predicted"), F.col("answer")
    said = F.when(c % 2 == 0, F.concat(F.lit("VERDICT: none, no: Verdict: "), T.letter(c))).otherwise("it is VERDICT: NONE")
    v = _three(s, d, "predicted").withColumn("v", analysis.verdict(said))
    kind = F.when(F.col("v") == "NONE", "none").when(F.col("v") == T.letter(gold), "gold").when(F.col("v") == T.letter(F.col("base_predicted")), "model").otherwise("third")
    return v.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_A3} SELECT sample_id FROM j WHERE NOT ca AND NOT cb AND NOT cc")
def j15_wrong_everywhere(s, d):
    return analysis.wrong_everywhere([run(s, d, a) for a in ("base", "armx", "army")])


@query(f"""WITH {MCQ}, o AS (SELECT sample_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY subject) AS n, lead(sample_id) OVER w AS nxt, first_value(sample_id) OVER w AS fst FROM mcq WINDOW w AS (PARTITION BY subject ORDER BY sha256('other|' || sample_id), sample_id))
SELECT sample_id, coalesce(nxt, fst) AS other FROM o WHERE n > 1""")
def j18_derangement(s, d):
    return analysis.deranged(mcq(s, d), "subject", "sample_id", "other")


@query(f"WITH {_EDGES}, near AS (SELECT doc_id FROM edges WHERE item_id IN (SELECT item_id FROM edges WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de'))) SELECT DISTINCT doc_id FROM edges WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') AND doc_id NOT IN (SELECT doc_id FROM near)")
def j19_untouched(s, d):
    return analysis.untouched(contamination.scan(_docs(s, d), _items(s, d)), "doc_id", "item_id", _docs(s, d).where("lang = 'de'").select("doc_id"))


@query(f"""WITH {_A3}, u AS (SELECT sample_id, unnest(['base', 'armx', 'army']) AS best, unnest([{sql_h("'cbase'", 'sample_id')}, {sql_h("'carmx'", 'sample_id')}, {sql_h("'carmy'", 'sample_id')}]) AS c FROM j)
SELECT sample_id, round(c, 12) AS coverage, best FROM u QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(c, 12) DESC, best) = 1""")
def u06_best_shard(s, d):
    return analysis.best_of({a: run(s, d, a).withColumn("coverage", F.round(T.h01(f"c{a}", F.col("sample_id")), 12)) for a in ("base", "armx", "army")}, "coverage", "sample_id")


# Rollouts, gates, labels.
@query(f"WITH {MCQ}, {ROLL}, g AS (SELECT sample_id, count(*) AS k, count(*) FILTER (predicted = answer) AS hits FROM roll GROUP BY 1) SELECT sample_id, hits, abs(hits - k / 2) AS distance FROM g WHERE hits BETWEEN 1 AND k - 1")
def g09_pass_band(s, d):
    g = rollouts(s, d).groupBy("sample_id").agg(F.count("*").alias("k"), F.count_if(F.col("predicted") == F.col("answer")).alias("hits"))
    return g.where("hits BETWEEN 1 AND k - 1").select("sample_id", "hits", F.abs(F.col("hits") - F.col("k") / 2).alias("distance"))


@query(f"WITH {_VOTE}, {sql_run('base')} SELECT CASE WHEN winner = predicted THEN 'keep' WHEN margin >= 0.5 THEN 'retain' ELSE 'flip' END AS tier, count(*) AS n FROM voted JOIN base USING (sample_id) GROUP BY 1")
def o11_label_tiers(s, d):
    j = voting.votes(rollouts(s, d)).join(run(s, d, "base").select("sample_id", "predicted"), "sample_id")
    return j.groupBy(F.when(F.col("winner") == F.col("predicted"), "keep").when(F.col("margin") >= 0.5, "retain").otherwise("flip").alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {MCQ} SELECT sample_id, array_to_string(choices, '|') AS options, answer AS gold FROM mcq WHERE {sql_byte("'cut|' || sample_id")} % 4 <> 0")
def g22_item_parse(s, d):
    """A quarter of the items lacks its option C and doesn't parse."""
    c = F.col("choices")
    cut = T.sha_byte(F.concat(F.lit("cut|"), "sample_id")) % 4 == 0
    text = F.concat(F.lit("Q: Which one?\nA) "), c[0], F.lit("\nB) "), c[1], F.when(cut, "").otherwise(F.concat(F.lit("\nC) "), c[2])), F.lit("\n  D) "), c[3], F.lit("\nA) again\nCORRECT: "), T.letter(F.col("answer")))
    return analysis.parsed_items(mcq(s, d).select("sample_id", text.alias("text"))).select("sample_id", F.array_join("options", "|").alias("options"), "gold")


@query(f"WITH {SAID} SELECT sample_id, round(CAST(lenient = chr(65 + answer) AS INT)::DOUBLE + 0.05::DOUBLE * CAST(lenient <> '' AS INT), 2) AS reward FROM comp")
def m10_reward(s, d):
    lenient = T.parse_letter(F.col("completion"), F.size("choices"))
    return completions(s, d).select("sample_id", analysis.reward(lenient, T.letter(F.col("answer"))).alias("reward"))


@query(f"WITH {SAID}, c AS (SELECT length(completion) AS n, CASE WHEN lenient = '' THEN 'unparsed' WHEN lenient = chr(65 + answer) THEN 'right' ELSE 'wrong' END AS outcome FROM comp) SELECT outcome, count(*) AS total, round(avg(n), 6) AS mean_length FROM c GROUP BY 1")
def a26_length_by_outcome(s, d):
    c = completions(s, d).select("answer", F.length("completion").alias("n"), T.parse_letter(F.col("completion"), F.size("choices")).alias("lenient"))
    kind = F.when(F.col("lenient") == "", "unparsed").when(F.col("lenient") == T.letter(F.col("answer")), "right").otherwise("wrong")
    return c.groupBy(kind.alias("outcome")).agg(F.count("*").alias("total"), F.round(F.avg("n"), 6).alias("mean_length"))


# Documents.
@query("WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n_chars) FILTER (i = n // 2) AS median, max(n_chars) FILTER (i = CAST(floor(0.9 * (n - 1)) AS BIGINT)) AS p90 FROM r GROUP BY 1")
def a08_quantile_places(s, d):
    return analysis.quantile_places(_docs(s, d), "lang", "n_chars")


@query("SELECT stage, n FROM (SELECT 'all' AS stage, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'english', count(DISTINCT doc_id) FROM documents WHERE lang = 'en' UNION ALL SELECT 'long', count(DISTINCT doc_id) FROM documents WHERE lang = 'en' AND n_chars >= 500) WHERE n > 0")
def a23_funnel(s, d):
    return analysis.funnel(_docs(s, d), "doc_id", [("all", F.lit(True)), ("english", F.col("lang") == "en"), ("long", F.col("n_chars") >= 500)])


@query("SELECT array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def a27_schema_fingerprint(s, d):
    return read(s, d, "events").where("props IS NOT NULL").groupBy(F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("fields")).agg(F.count("*").alias("n"))


_SENT = r"string_split(regexp_replace({0}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, len({_SENT.format('text')}) AS sentences, len(list_filter({_SENT.format('text')}, lambda x: regexp_matches(x, '[0-9]'))) AS numeric_sentences FROM documents")
def k09_sentences(s, d):
    x = _docs(s, d).select("doc_id", F.split("text", r"(?<=[.!?])[ \t\n\r\f]+").alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("sentences"), F.size(F.filter("x", lambda t: t.rlike("[0-9]"))).cast("long").alias("numeric_sentences"))


@query(f"WITH t AS (SELECT doc_id, list_filter({_W.format('text')}, lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[1:20], ' ') AS head FROM t")
def p30_truncate_words(s, d):
    return _docs(s, d).select("doc_id", F.array_join(F.slice(T.plain_words(F.col("text")), 1, 20), " ").alias("head"))


@query(f"""WITH {_EDGES}, {_ITERMS}, dt AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM edges))
SELECT doc_id, item_id, round(count(*) FILTER (contains(t, term)) / count(*), 6) AS support FROM edges JOIN dt USING (doc_id) JOIN it USING (item_id) GROUP BY ALL""")
def r10_support(s, d):
    """Share of an item's terms that a document it touches has as a substring."""
    docs = _docs(s, d).select("doc_id", F.lower("text").alias("t"))
    terms = _items(s, d).select("item_id", T.content_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    j = contamination.scan(_docs(s, d), _items(s, d)).join(docs, "doc_id").join(contamination.small(terms), "item_id")
    return j.select("doc_id", "item_id", F.round(F.expr("size(filter(terms, x -> contains(t, x))) / size(terms)"), 6).alias("support"))


@query(r"SELECT doc_id FROM documents WHERE array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') NOT IN (SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') FROM benchmark)")
def c17_key_guard(s, d):
    own = _items(s, d).select(T.norm_tokens(F.col("text")).alias("key")).distinct()
    return _docs(s, d).select("doc_id", T.norm_tokens(F.col("text")).alias("key")).join(contamination.small(own), "key", "left_anti").select("doc_id")


@query(f"WITH {_EDGES}, n AS (SELECT doc_id, array_to_string(w, ' ') AS t FROM dw), m AS (SELECT item_id, array_to_string(w, ' ') AS q FROM iw) SELECT doc_id, item_id FROM edges JOIN n USING (doc_id) JOIN m USING (item_id) WHERE length(q) > 40 AND contains(t, q)")
def c08_verbatim(s, d):
    """Pairs whose shingles meet, and of these the documents that hold the whole item."""
    plain = lambda t: F.array_join(T.plain_words(F.col("text")), " ").alias(t)
    pairs = contamination.scan(_docs(s, d), _items(s, d))
    own = _items(s, d).select("item_id", plain("q")).where("length(q) > 40")
    return pairs.join(contamination.small(own), "item_id").join(_docs(s, d).select("doc_id", plain("t")), "doc_id").where("contains(t, q)").select("doc_id", "item_id")


@query(f"WITH t AS (SELECT doc_id, list_filter({_W.format('text')}, lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS place FROM t) SELECT doc_id, place, array_to_string(w[place + 1:place + 50], ' ') AS text FROM c WHERE len(w[place + 1:place + 50]) >= 10")
def k06_fixed_chunks(s, d):
    w = _docs(s, d).select("doc_id", T.plain_words(F.col("text")).alias("w")).where("size(w) > 0")
    c = w.select("doc_id", F.explode(F.expr("transform(sequence(0, size(w) - 1, 50), i -> struct(CAST(i AS BIGINT) AS place, slice(w, i + 1, 50) AS part))")).alias("c"))
    return c.where("size(c.part) >= 10").select("doc_id", "c.place", F.array_join("c.part", " ").alias("text"))


_RANKED = f"{_BM25}, rk AS (SELECT item_id, doc_id, rank, n_chars, text FROM bm JOIN documents USING (doc_id))"


def _ranked(s, d):
    return r01_bm25_top20(s, d).select("item_id", "doc_id", "rank").join(_docs(s, d).select("doc_id", "n_chars", "text"), "doc_id")


@query(f"WITH {_RANKED} SELECT item_id, doc_id, rank FROM rk QUALIFY sum(n_chars) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 20000")
def k10_context_trim(s, d):
    return analysis.fitting_prefix(_ranked(s, d).drop("text"), "item_id", "rank", "n_chars", 20000).select("item_id", "doc_id", "rank")


@query(f"WITH {_RANKED}, f AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY item_id, substr(text, 1, 120) ORDER BY rank) = 1) SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rank) AS INTEGER) AS place FROM f QUALIFY place <= 3")
def w05_distinct_prefixes(s, d):
    return analysis.distinct_prefixes(_ranked(s, d), "item_id", "rank", "text").select("item_id", "doc_id", "place")


@query(f"WITH {MCQ}, {ROLL}, f AS (SELECT sample_id, min(k) + 1 AS rank FROM roll WHERE predicted = answer GROUP BY 1), t AS (SELECT CAST(unnest([1, 2, 4, 8]) AS INTEGER) AS depth) SELECT depth, count(*) FILTER (rank <= depth) AS reached FROM f, t GROUP BY 1")
def w07_depth_curve(s, d):
    first = rollouts(s, d).where("predicted = answer").groupBy("sample_id").agg((F.min("k") + 1).alias("rank"))
    return contamination.pooled_depth(first, [1, 2, 4, 8])


@query(f"WITH {_RUNS}, b AS (SELECT CAST(floor((CAST(substr(sample_id, 3) AS BIGINT) - 1) / 100) AS BIGINT) AS block, count(*) AS n, count(*) FILTER (correct) AS c FROM base GROUP BY 1), r AS (SELECT block, CAST(sum(n) OVER w AS BIGINT) AS seen, CAST(sum(c) OVER w AS BIGINT) AS \"right\" FROM b WINDOW w AS (ORDER BY block)) SELECT *, round(\"right\" / seen, 6) AS accuracy FROM r")
def i02_progress(s, d):
    return analysis.progress(run(s, d, "base").withColumn("place", F.substring("sample_id", 3, 20).cast("long")), "place")


@query(f"WITH {_A3}, f AS (SELECT *, {sql_h("'ctx'", 'sample_id')} < 0.6 AS f FROM j), g AS (SELECT avg(CAST(cb AS INT)) FILTER (f) - avg(CAST(ca AS INT)) FILTER (f) AS i, avg(CAST(cb AS INT)) FILTER (NOT f) - avg(CAST(ca AS INT)) FILTER (NOT f) AS o FROM f) SELECT round(i, 6) AS inside, round(o, 6) AS outside, round(i - o, 6) AS did FROM g")
def x16_difference_in_differences(s, d):
    r = _three(s, d, "correct").withColumn("f", T.h01("ctx", F.col("sample_id")) < 0.6)
    return analysis.difference_in_differences(r, "f", "base_correct", "armx_correct")


@query(f"WITH r AS ({_SQL['p23_token_f1']}) SELECT count(*) AS pairs, count(*) FILTER (f1 = 1) AS exact, round(avg(f1), 6) AS mean_f1, count(*) FILTER (f1 >= 0.1) AS near FROM r")
def x15_reconstruction(s, d):
    return p23_token_f1(s, d).agg(F.count("*").alias("pairs"), F.count_if(F.col("f1") == 1).alias("exact"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.count_if(F.col("f1") >= 0.1).alias("near"))


@query(f"WITH p AS ({_SQL['p10_parse_answer']}), r AS ({_SQL['p12_recover_answer']}), {MCQ} SELECT count(*) FILTER (official <> '') AS strict_read, count(*) FILTER (official <> '' AND recovered = official) AS agreed, count(*) FILTER (official = '' AND recovered <> '') AS recovered_rows, count(*) FILTER (official = '' AND recovered = chr(65 + answer)) AS recovered_right FROM p JOIN r USING (sample_id) JOIN mcq USING (sample_id)")
def x30_reextraction(s, d):
    j = p10_parse_answer(s, d).join(p12_recover_answer(s, d), "sample_id").join(mcq(s, d).select("sample_id", "answer"), "sample_id")
    read_, again = F.col("official") != "", F.col("recovered")
    return j.agg(F.count_if(read_).alias("strict_read"), F.count_if(read_ & (again == F.col("official"))).alias("agreed"), F.count_if(~read_ & (again != "")).alias("recovered_rows"), F.count_if(~read_ & (again == T.letter(F.col("answer")))).alias("recovered_right"))


@query(f"WITH {_RUNS}, u AS (SELECT 'base' AS arm, subject, correct FROM base UNION ALL SELECT 'armx', subject, correct FROM armx UNION ALL SELECT 'army', subject, correct FROM army), o AS (SELECT arm, count(*) FILTER (correct) / count(*) AS p FROM u GROUP BY 1) SELECT arm, round(100 * p, 2) AS overall, round(100 * p - 100 * (SELECT p FROM o WHERE arm = 'base'), 2) AS delta FROM o")
def x14_leakage(s, d):
    r = _three(s, d, "correct").select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_correct").alias("c"), F.col("base_correct").alias("b")) for a in ("base", "armx", "army")])).alias("x")).select("x.*")
    rate = lambda c: 100 * (F.count_if(c) / F.count("*"))
    return r.groupBy("arm").agg(F.round(rate("c"), 2).alias("overall"), F.round(rate("c") - rate("b"), 2).alias("delta"))


@query(f"WITH {_A3} SELECT sample_id, chr(65 + pa) AS letter FROM j WHERE pa = pb AND pb = pc")
def g20_agreement(s, d):
    return _three(s, d, "predicted").where("base_predicted = armx_predicted AND armx_predicted = army_predicted").select("sample_id", T.letter(F.col("base_predicted")).alias("letter"))


@query(f"WITH {MCQ}, r AS (SELECT sample_id, sample_id || ':' || CAST(unnest(range(4)) AS VARCHAR) AS view_id FROM mcq) SELECT sample_id, view_id FROM r QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sha256('rot|' || view_id), view_id) <= 2")
def o12_two_rotations(s, d):
    r = mcq(s, d).select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("sample_id", F.concat("sample_id", F.lit(":"), F.col("k").cast("string")).alias("view_id"))
    return dedup.top_by_hash(r, "sample_id", "view_id", "rot", 2)


@query(f"WITH {_RUNS}, n AS (SELECT count(*) AS n FROM base) SELECT chr(CAST(65 + i AS INTEGER)) AS letter, round(count(*) FILTER (predicted = i) / any_value(n), 6) AS said, round(count(*) FILTER (answer = i) / any_value(n), 6) AS gold FROM base, n, (SELECT unnest(range(4)) AS i) GROUP BY i")
def a24_letter_share(s, d):
    r = run(s, d, "base").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in ("predicted", "answer") for i in range(4)])
    letters = F.array(*[F.struct(F.lit(T.LETTERS[i]).alias("letter"), F.round(F.col(f"predicted{i}") / F.col("n"), 6).alias("said"), F.round(F.col(f"answer{i}") / F.col("n"), 6).alias("gold")) for i in range(4)])
    return r.select(F.explode(letters).alias("x")).select("x.*")


@query(f"WITH t AS (SELECT role, len(list_filter({_W.format('text')}, lambda x: x <> '')) AS n FROM conversations), g AS (SELECT role, count(*) AS rows_n, CAST(sum(n) AS BIGINT) AS words FROM t GROUP BY 1) SELECT *, round(words / sum(words) OVER (), 6) AS share FROM g")
def a20_role_words(s, d):
    from pyspark.sql import Window as W

    g = read(s, d, "conversations").groupBy("role").agg(F.count("*").alias("rows_n"), F.sum(F.size(T.plain_words(F.col("text")))).alias("words"))
    return g.withColumn("share", F.round(F.col("words") / F.sum("words").over(W.partitionBy()), 6))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(DISTINCT CAST(user_id AS VARCHAR) || event_type) AS pairs FROM events")
def a06_distinct_counts(s, d):
    e = read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return e.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.count("*").alias("pairs"))


@query("SELECT event_id, 2 AS objects FROM events WHERE json_valid(props)")
def p29_json_lines(s, d):
    e = read(s, d, "events").select("event_id", F.concat(F.lit("Here it is:\n"), "props", F.lit(',\n{"x": 1},\n{bad}\n{"cut": ')).alias("t"))
    return e.select("event_id", F.size(T.json_lines(F.col("t"))).alias("objects"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(x, '[#$%&*]')), ' ') AS text FROM documents")
def p28_scrub(s, d):
    return _docs(s, d).select("doc_id", T.drop_sentences(F.col("text"), "[#$%&*]").alias("text"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u02_intersection(s, d):
    return _docs(s, d).where("lang = 'en'").select("doc_id").intersect(read(s, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def u03_difference(s, d):
    return _docs(s, d).where("lang = 'en'").select("doc_id").join(read(s, d, "labels").select("doc_id"), "doc_id", "left_anti").distinct()
