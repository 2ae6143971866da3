"""Registered queries of the library and their DuckDB forms; keys begin with the operator's id in the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import contamination, dedup, gates, joins, retrieval, sampling, scoring, voting
from ..sources import scorers
from ..streaming import appends
from .derived import MCQ, ROLL, SAID, completions, mcq, read, rollouts, run, sql_byte, sql_h, sql_run

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB form if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(s, d):
    return read(s, d, "documents")


def _items(s, d):
    return read(s, d, "benchmark")


_W = r"string_split(trim(regexp_replace(lower({0}), '[ \t\n\r\f]+', ' ', 'g')), ' ')"
#: Unicode's white space for RE2.
_US = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sw(text: str) -> str:
    return f"list_filter(string_split(lower(trim(regexp_replace(regexp_replace({text}, '\\[[^\\]]*\\]', '', 'g'), '{_US}+', ' ', 'g'))), ' '), lambda x: x <> '')"


_WORDS = f"dw AS (SELECT doc_id, list_filter({_W.format('text')}, lambda x: x <> '') AS w FROM documents), iw AS (SELECT item_id, list_filter({_W.format('text')}, lambda x: x <> '') AS w FROM benchmark)"
_SWORDS = f"dw AS (SELECT doc_id, {_sw('text')} AS w FROM documents), iw AS (SELECT item_id, {_sw('text')} AS w FROM benchmark)"
_GRAMS = "list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i:i + 7], ' '))"
_EDGES = f"""{_SWORDS},
ish AS (SELECT shingle, min(item_id) AS item_id FROM (SELECT item_id, unnest({_GRAMS}) AS shingle FROM iw) GROUP BY 1),
dsh AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS shingle FROM dw),
edges AS (SELECT DISTINCT doc_id, item_id FROM dsh JOIN ish USING (shingle))"""
_ALL = r"regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9.\-]{{2,}}')"


def _terms(text: str, stop: list[str] = T.RETRIEVAL_STOP) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stop)
    return f"list_distinct(list_filter({_ALL.format(text)}, lambda x: NOT list_contains([{listed}], x)))"


def _coverage(text: str) -> str:
    return _terms(f"regexp_replace({text}, '\\[[^\\]]*\\]', ' ', 'g')", T.COVERAGE_STOP)


_ITERMS = f"it AS (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark)"
_WIN = f"""win0 AS (SELECT doc_id, w, unnest(range(0, len(w), 20)) AS start FROM (SELECT doc_id, list_filter({_W.format('text')}, lambda x: x <> '') AS w FROM documents)),
win AS (SELECT doc_id, CAST(start AS INTEGER) AS start, doc_id * 1000000 + start AS win_id, array_to_string(w[start + 1:start + 40], ' ') AS text FROM win0 WHERE start = 0 OR len(w[start + 1:start + 40]) * 3 >= 40)"""


# Contamination and coverage.
def _tagged(d):
    """Texts with tags, white space of other kinds and a change of case between their words; a scan must not see them."""
    return d.withColumn("text", F.concat(F.lit("[Release 7] "), F.regexp_replace("text", "^([^ ]+) ", "$1 [see\u00a0 note] \u2003"), F.lit("\u3000[end]")))


@query(f"WITH {_EDGES} SELECT item_id, count(*) AS n_records FROM edges GROUP BY 1")
def c03_shingle_scan(s, d):
    return contamination.hits_by_item(contamination.scan(_docs(s, d), _items(s, d)))


@query(f"WITH {_EDGES} SELECT item_id, count(*) AS n_records FROM edges GROUP BY 1")
def c03_scan_of_tagged_texts(s, d):
    """The same hits, though items and documents are full of tags."""
    return contamination.hits_by_item(contamination.scan(_tagged(_docs(s, d)), _tagged(_items(s, d))))


@query(f"WITH {_EDGES} SELECT item_id, count(*) AS n_records FROM edges GROUP BY 1")
def c04_prefix_stripped_scan(s, d):
    """Items under one boilerplate header; with it stripped the hits are those of the bare items."""
    items = _items(s, d).withColumn("text", F.concat(F.lit("Answer the question about\nthe corpus in one word: "), "text"))
    return contamination.hits_by_item(contamination.scan(_docs(s, d), contamination.without_prefix(items, "^Answer the question.*?in one word: ")))


@query(f"WITH {_EDGES} SELECT (SELECT count(DISTINCT item_id) FROM edges) AS hit, count(*) AS total, round((SELECT count(DISTINCT item_id) FROM edges) / count(*), 6) AS frac, count(*) FILTER (len(w) < 8) AS too_short FROM iw")
def c03_scan_summary(s, d):
    return contamination.scan_summary(contamination.scan(_docs(s, d), _items(s, d)), _items(s, d))


def _gold(items):
    """The gold of every other item are its first three words, else words that no text has."""
    return items.withColumn("gold", F.when(F.col("item_id") % 2 == 0, F.array_join(F.slice(T.scan_words(F.col("text")), 1, 3), " ")).otherwise(F.concat(F.lit("no such words "), F.col("item_id").cast("string"))))


@query(f"""WITH {_EDGES}, tails AS (SELECT item_id, array_to_string(w[len(w) - 7:], ' ') AS shingle, array_to_string(w, ' ') AS item,
    CASE WHEN item_id % 2 = 0 THEN array_to_string(w[1:3], ' ') ELSE 'no such words ' || CAST(item_id AS VARCHAR) END AS gold FROM iw WHERE len(w) >= 8),
m AS (SELECT item_id, contains(array_to_string(w, ' '), item) AS f, contains(array_to_string(w, ' '), gold) AS g FROM dsh JOIN tails USING (shingle) JOIN dw USING (doc_id))
SELECT item_id, count(*) AS tail_hits, count(*) FILTER (f) AS full_hits, count(*) FILTER (f AND g) AS gold_hits FROM m GROUP BY 1""")
def c05_tail_verify_tiers(s, d):
    return contamination.tail_tiers(_tagged(_docs(s, d)), _gold(_items(s, d)))


@query(f"""WITH {_SWORDS}, k AS (SELECT array_to_string(w, ' ') AS t FROM iw UNION SELECT array_to_string(w[greatest(1, len(w) - 7):], ' ') FROM iw WHERE len(w) >= 8)
SELECT DISTINCT doc_id FROM dw WHERE array_to_string(w, ' ') IN (SELECT t FROM k) OR array_to_string(w[greatest(1, len(w) - 7):], ' ') IN (SELECT t FROM k)""")
def c06_copy_check(s, d):
    return contamination.copy_check(_docs(s, d), _tagged(_items(s, d)))


@query(f"WITH {_WORDS} SELECT doc_id FROM dw WHERE array_to_string(w[greatest(1, len(w) - 5):], ' ') NOT IN (SELECT array_to_string(w[greatest(1, len(w) - 5):], ' ') FROM iw)")
def c07_tail_guard(s, d):
    return contamination.without_tails(_docs(s, d), _items(s, d), 6).select("doc_id")


def _coverage_sql(units: str, unit: str, terms: str, of) -> str:
    return f"""ut AS (SELECT {unit}, unnest({of('text')}) AS term FROM {units}), nt AS (SELECT item_id, count(*) AS n_terms FROM {terms} GROUP BY 1),
sh AS (SELECT item_id, {unit}, count(*) AS n FROM ut JOIN {terms} USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, {unit}) AS k FROM sh),
cov AS (SELECT nt.item_id, n_terms, round(coalesce(n, 0) / n_terms, 6) AS coverage, {unit} AS best FROM nt LEFT JOIN r ON nt.item_id = r.item_id AND k = 1)"""


def _contained(text: str) -> str:
    return _terms(text, T.CONTAINMENT_STOP)


def _containment(c):
    return T.content_terms(c, T.CONTAINMENT_STOP)


_RARE = f"ct AS (SELECT item_id, unnest({_coverage('text')}) AS term FROM benchmark), rare AS (SELECT ct.* FROM ct JOIN (SELECT term FROM ct GROUP BY 1 HAVING count(*) <= 2) USING (term))"
_CTERMS = f"ct AS (SELECT item_id, unnest({_contained('text')}) AS term FROM benchmark)"


@query(f"WITH {_RARE}, {_coverage_sql('documents', 'doc_id', 'rare', _coverage)} SELECT * FROM cov")
def c09_rare_term_coverage(s, d):
    return contamination.best_coverage(_docs(s, d), "doc_id", contamination.rare_terms(_items(s, d), 2))


@query(f"""WITH {_RARE}, {_coverage_sql('documents', 'doc_id', 'rare', _coverage)} SELECT count(*) AS items, count(*) FILTER (coverage = 1) AS "full", count(*) FILTER (coverage >= 0.8) AS ge80,
count(*) FILTER (coverage >= 0.5) AS ge50, count(*) FILTER (coverage < 0.2) AS lt20, round(avg(coverage), 6) AS mean FROM cov""")
def c09_coverage_buckets(s, d):
    return contamination.coverage_buckets(c09_rare_term_coverage(s, d))


@query(f"WITH {_CTERMS}, {_coverage_sql('documents', 'doc_id', 'ct', _contained)} SELECT * FROM cov")
def c10_doc_containment(s, d):
    return contamination.best_coverage(_docs(s, d), "doc_id", contamination.item_terms(_items(s, d), _containment), _containment)


@query(f"WITH {_CTERMS}, {_WIN}, {_coverage_sql('win', 'win_id', 'ct', _contained)} SELECT * FROM cov")
def c11_window_containment(s, d):
    return contamination.best_coverage(contamination.windows(_docs(s, d)), "win_id", contamination.item_terms(_items(s, d), _containment), _containment)


@query(f"""WITH {_RARE}, ut AS (SELECT doc_id, unnest({_coverage('text')}) AS term FROM documents), n AS (SELECT item_id, count(*) AS n FROM rare GROUP BY 1),
h AS (SELECT item_id, doc_id FROM ut JOIN rare USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*) >= 0.6 * n) SELECT doc_id, count(*) AS explains FROM h GROUP BY 1""")
def c13_errors_to_documents(s, d):
    terms = contamination.rare_terms(_items(s, d), 2)
    n = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    own = _docs(s, d).select("doc_id", F.explode(T.coverage_terms(F.col("text"))).alias("term"))
    hit = own.join(contamination.small(terms), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("h")).join(contamination.small(n), "item_id").where("h >= 0.6 * n")
    return hit.groupBy("doc_id").agg(F.count("*").alias("explains"))


# Retrieval.
_BM25 = f"""{_ITERMS}, tok AS (SELECT doc_id, {_ALL.format('text')} AS t FROM documents), facts AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), facts WHERE df <= 0.25 * n),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN it USING (term) GROUP BY ALL),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 20)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bm")
def r01_bm25_top20(s, d):
    return retrieval.bm25(_docs(s, d), _items(s, d))


@query(f"""WITH {_BM25}, {_WIN}, sw AS (SELECT * FROM win WHERE doc_id IN (SELECT doc_id FROM bm)), hv AS (SELECT doc_id, win_id, unnest({_terms('text')}) AS term FROM sw),
widf AS (SELECT term, ln(1 + ((SELECT count(*) FROM sw) - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM hv GROUP BY 1)),
ws AS (SELECT bm.item_id, win_id, round(sum(idf), 6) AS score FROM hv JOIN widf USING (term) JOIN it USING (term) JOIN bm ON bm.item_id = it.item_id AND bm.doc_id = hv.doc_id GROUP BY ALL),
wr AS (SELECT ws.*, substr(text, 1, 120) AS b FROM ws JOIN win USING (win_id)), wd AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY item_id, b ORDER BY score DESC, win_id) = 1)
SELECT item_id, win_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, win_id) AS INTEGER) AS rank FROM wd QUALIFY rank <= 8""")
def r02_window_rescore(s, d):
    return retrieval.rescored_windows(contamination.windows(_docs(s, d)), r01_bm25_top20(s, d), _items(s, d), 8)


@query(f"""WITH {_BM25}, c AS (SELECT item_id, {_terms("text")} AS c FROM (SELECT item_id, string_agg(text, ' ') AS text FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1)),
g AS (SELECT item_id, {_terms('text')} AS g FROM benchmark) SELECT item_id, coalesce(len(g) > 0 AND len(list_intersect(g, c)) >= 0.8 * len(g), false) AS found FROM g LEFT JOIN c USING (item_id)""")
def r03_answer_in_ctx(s, d):
    best = r01_bm25_top20(s, d).where("rank <= 3").join(_docs(s, d).select("doc_id", "text"), "doc_id")
    context = best.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"))
    return retrieval.answer_in_context(context, _items(s, d))


@query("""WITH n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (q.n * p.n), 6) AS score
FROM n q JOIN n p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 AND q.n > 0 AND p.n > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def r07_dense_top_k(s, d):
    e = read(s, d, "embeddings")
    return retrieval.dense_rerank(e, e.where("vec_id % 50 = 0"))


@query(f"""WITH {_ITERMS}, o AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents), idf AS (SELECT term, pow(ln((SELECT count(*) FROM documents) / count(*)), 2) AS w FROM o GROUP BY 1 HAVING count(*) < 0.2 * (SELECT count(*) FROM documents)),
dn AS (SELECT doc_id, sqrt(sum(w)) AS dn FROM o JOIN idf USING (term) GROUP BY 1), q AS (SELECT * FROM it JOIN idf USING (term)), qn AS (SELECT item_id, sqrt(sum(w)) AS qn FROM q GROUP BY 1),
sc AS (SELECT item_id, doc_id, round(sum(w) / (any_value(dn) * any_value(qn)), 6) AS score FROM o JOIN q USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3""")
def r08_idf_cosine(s, d):
    return retrieval.idf_cosine(_docs(s, d), _items(s, d))


# Parsing and projections.
@query(f"WITH {SAID} SELECT sample_id, lenient, official FROM comp")
def p10_parse_answer(s, d):
    c = completions(s, d)
    n = F.size("choices")
    return c.select("sample_id", T.parse_letter(F.col("completion"), n).alias("lenient"), T.parse_letter(F.col("completion"), n, bare=False).alias("official"))


@query(f"WITH {SAID} SELECT count(*) AS total, count(*) FILTER (lenient = chr(65 + answer)) AS lenient_right, count(*) FILTER (official = chr(65 + answer)) AS official_right, count(*) FILTER (lenient <> '' AND official = '') AS bare_only FROM comp")
def x09_parser_audit(s, d):
    c = completions(s, d).select("sample_id", "answer").join(p10_parse_answer(s, d), "sample_id")
    gold = T.letter(F.col("answer"))
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("lenient") == gold).alias("lenient_right"), F.count_if(F.col("official") == gold).alias("official_right"), F.count_if((F.col("lenient") != "") & (F.col("official") == "")).alias("bare_only"))


@query(f"WITH {SAID} SELECT sample_id, recovered FROM comp")
def p12_recover_answer(s, d):
    return completions(s, d).select("sample_id", T.recover_letter(F.col("completion")).alias("recovered"))


@query(f"WITH {MCQ} SELECT sample_id, 'Answer with one of A,B,C,D.' || chr(10) || chr(10) || 'Which one?' || chr(10) || 'A) ' || choices[1] || chr(10) || 'B) ' || choices[2] || chr(10) || 'C) ' || choices[3] || chr(10) || 'D) ' || choices[4] AS prompt FROM mcq")
def p13_render_prompt(s, d):
    return mcq(s, d).select("sample_id", T.render_prompt(F.lit("Which one?"), F.col("choices")).alias("prompt"))


@query(f"WITH {MCQ}, r AS (SELECT *, {sql_byte('sample_id')} % 4 AS shift FROM mcq) SELECT sample_id, shift, array_to_string([choices[(i + shift) % 4 + 1] for i in range(4)], '|') AS rotated, (answer - shift + 4) % 4 AS answer FROM r")
def p15_rotate_choices(s, d):
    q = mcq(s, d).withColumn("shift", T.sha_byte(F.col("sample_id")) % F.size("choices"))
    return q.select("sample_id", "shift", F.array_join(T.rotate_left("choices", "shift"), "|").alias("rotated"), F.expr("pmod(answer - shift, size(choices))").alias("answer"))


@query(f"WITH {MCQ} SELECT sample_id, round({sql_h("'keep'", 'sample_id')}, 12) AS draw, {sql_byte('sample_id')} AS byte0 FROM mcq")
def p17_hash_draw(s, d):
    return mcq(s, d).select("sample_id", F.round(T.h01("keep", F.col("sample_id")), 12).alias("draw"), T.sha_byte(F.col("sample_id")).alias("byte0"))


@query(r"SELECT doc_id, md5(trim(lower(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))) AS content_key, substr(sha256(text), 1, 16) AS content_id FROM documents")
def p18_content_keys(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.norm_ws_lower(F.col("text"))).alias("content_key"), T.content_id(F.col("text")).alias("content_id"))


@query(f"WITH {MCQ} SELECT sample_id, CAST(list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1 AS INTEGER) AS guess FROM mcq")
def p20_heuristic_answer(s, d):
    return mcq(s, d).select("sample_id", T.heuristic_index("choices").alias("guess"))


@query(f"WITH {MCQ} SELECT sample_id, regexp_matches(choices[4], '[0-9]') AS numeric_option, length(choices[answer + 1]) = list_max(list_transform(choices, lambda c: length(c))) AS gold_longest, round(list_max(list_transform(choices, lambda c: length(c))) / list_min(list_transform(choices, lambda c: length(c))), 6) AS length_ratio FROM mcq")
def p22_item_shape(s, d):
    n = F.transform("choices", F.length)
    return mcq(s, d).select("sample_id", F.col("choices")[3].rlike("[0-9]").alias("numeric_option"), (F.length(F.col("choices")[F.col("answer")]) == F.array_max(n)).alias("gold_longest"), F.round(F.array_max(n) / F.array_min(n), 6).alias("length_ratio"))


@query(f"""WITH e AS (SELECT item_id, {_W.format('text')} AS a FROM benchmark), p AS (SELECT x.item_id, y.item_id AS other, x.a, y.a AS b FROM e x JOIN e y ON y.item_id = x.item_id + 1)
SELECT item_id, other, round(2 * list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))) / (len(a) + len(b)), 6) AS f1, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM p""")
def p23_token_f1(s, d):
    e = _items(s, d).select("item_id", T.plain_words(F.col("text")).alias("a"))
    p = e.join(e.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("a").alias("b")), "item_id")
    return p.select("item_id", "other", F.round(T.token_f1("a", "b"), 6).alias("f1"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens, round(len(regexp_extract_all(text, '[^ \t\n\r\f]+')) * 1.35, 4) AS token_estimate FROM documents")
def p07_norm_tokens(s, d):
    return _docs(s, d).select("doc_id", T.norm_tokens(F.col("text")).alias("tokens"), F.round(F.size(T.plain_words(F.col("text"))) * 1.35, 4).alias("token_estimate"))


# Gates.
_MC = "regexp_matches(text, '[#$%&*]{3}')"


@query(r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marks' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason FROM documents) GROUP BY 1""")
def g04_ordered_gate(s, d):
    t = F.col("text")
    return gates.report(gates.first_reason(_docs(s, d), [("short", F.length(t) < 200), ("table", t.contains(" | ")), ("marks", t.rlike("[#$%&*]{3}")), ("language", F.col("lang") != "en")]))


@query(r"""WITH r AS (SELECT unnest(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marks' END, CASE WHEN lang <> 'en' THEN 'language' END,
CASE WHEN length(text) >= 200 AND NOT contains(text, ' | ') AND NOT regexp_matches(text, '[#$%&*]{3}') AND lang = 'en' THEN 'kept' END], lambda x: x IS NOT NULL)) AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def g03_static_gate_reasons(s, d):
    t = F.col("text")
    return gates.reasons_report(gates.all_reasons(_docs(s, d), [("short", F.length(t) < 200), ("table", t.contains(" | ")), ("marks", t.rlike("[#$%&*]{3}")), ("language", F.col("lang") != "en")]))


@query(f"""WITH {_WORDS}, t AS (SELECT doc_id, len(w) AS n, array_to_string(w[greatest(1, len(w) - 5):], ' ') AS tail FROM dw), b AS (SELECT DISTINCT array_to_string(w[greatest(1, len(w) - 5):], ' ') AS tail FROM iw),
c AS (SELECT t.*, n < 20 AS bad, tail IN (SELECT tail FROM b) AS leak FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY tail, bad OR leak ORDER BY doc_id) AS r FROM c)
SELECT CASE WHEN bad THEN 'schema' WHEN leak THEN 'contamination' WHEN r > 1 THEN 'dup' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def g02_item_gate(s, d):
    """A row that is dropped for another reason doesn't mark its tail as seen."""
    w = _docs(s, d).select("doc_id", T.plain_words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), T.tail("w", 6).alias("tail"))
    own = _items(s, d).select(T.plain_words(F.col("text")).alias("w")).select(T.tail("w", 6).alias("tail")).distinct().withColumn("leak", F.lit(True))
    w = w.join(contamination.small(own), "tail", "left").withColumn("dropped", (F.col("n") < 20) | F.coalesce("leak", F.lit(False)))
    first = w.where("NOT dropped").groupBy("tail").agg(F.min("doc_id").alias("first"))
    w = w.join(first, "tail", "left")
    return gates.report(gates.first_reason(w, [("schema", F.col("n") < 20), ("contamination", F.coalesce("leak", F.lit(False))), ("dup", F.col("doc_id") > F.col("first"))]))


# Windows, dedup and caps.
@query(r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(lower(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))")
def w01_exact_dedup(s, d):
    keyed = _docs(s, d).select("doc_id", F.sha2(T.norm_ws_lower(F.col("text")), 256).alias("key"))
    return dedup.first_of(keyed, "key", "doc_id").select("doc_id")


@query(f"WITH {_WORDS} SELECT min(doc_id) AS doc_id FROM dw GROUP BY array_to_string(w[greatest(1, len(w) - 5):], ' ')")
def w02_tail_dedup(s, d):
    w = _docs(s, d).select("doc_id", T.plain_words(F.col("text")).alias("w")).select("doc_id", T.tail("w", 6).alias("tail"))
    return dedup.first_of(w, "tail", "doc_id").select("doc_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= greatest(5, CAST(floor((SELECT count(*) FROM documents) * 0.03) AS BIGINT))")
def w03_capped(s, d):
    return dedup.capped(_docs(s, d).select("doc_id", "source"), "source", "doc_id", 0.03, 5)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('pick|' || CAST(doc_id AS VARCHAR)), doc_id) <= 10")
def w04_topn_hash(s, d):
    return dedup.top_by_hash(_docs(s, d).select("doc_id", "source"), "source", "doc_id", "pick", 10)


@query("SELECT doc_id FROM documents QUALIFY coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000")
def w11_budget_pick(s, d):
    return dedup.budget_prefix(_docs(s, d).select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", "n_chars", 50000).select("doc_id")


@query("WITH t AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) SELECT doc_id, CAST(floor(b / 4096) AS BIGINT) AS first_block, CAST(floor((b + greatest(n_chars, 1) - 1) / 4096) AS BIGINT) AS last_block FROM t")
def w13_block_packing(s, d):
    return dedup.blocks(_docs(s, d).select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 4096).select("doc_id", "first_block", "last_block")


@query("WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n, count(*) OVER () AS c FROM benchmark), r AS (SELECT *, unnest(range(10)) AS round FROM p) SELECT item_id, CAST(item_id AS VARCHAR) || '#' || CAST(round AS VARCHAR) AS row_id FROM r WHERE round * c + n <= floor(c * 3.25)")
def w14_cycle_pool(s, d):
    return dedup.cycle(_items(s, d).select("item_id"), "item_id", 3.25).select("item_id", "row_id")


@query(f"""WITH RECURSIVE {_BM25}, p AS (SELECT item_id, doc_id, rank, n_chars FROM bm JOIN documents USING (doc_id)),
f AS (SELECT item_id, 0 AS rank, CAST(6000 AS BIGINT) AS "left", CAST(NULL AS BIGINT) AS doc_id, false AS taken FROM (SELECT DISTINCT item_id FROM p)
      UNION ALL SELECT p.item_id, p.rank, CASE WHEN p.n_chars <= f."left" THEN f."left" - p.n_chars ELSE f."left" END, p.doc_id, p.n_chars <= f."left" FROM f JOIN p ON p.item_id = f.item_id AND p.rank = f.rank + 1)
SELECT item_id, doc_id, rank FROM f WHERE taken""")
def w17_budget_skip(s, d):
    """An item's best documents that fit 6,000 characters one after another, skipping those that overflow."""
    pool = r01_bm25_top20(s, d).select("item_id", "doc_id", "rank").join(_docs(s, d).select("doc_id", F.col("n_chars").cast("long").alias("n_chars")), "doc_id")
    return dedup.budget_skip(pool, "item_id", "rank", "n_chars", 6000).select("item_id", "doc_id", "rank")


# Sampling and splits.
@query("""SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('held|' || CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, round(100.0 * (count(*) OVER (PARTITION BY source)) / (SELECT count(*) FROM documents)))""")
def o04_stratified_split(s, d):
    return sampling.stratified(_docs(s, d).select("doc_id", "source"), "source", "doc_id", "held", 100).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {sql_h("'val'", 'CAST(doc_id AS VARCHAR)')} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def o05_threshold_split(s, d):
    return sampling.threshold_split(_docs(s, d).select("doc_id"), "doc_id", 0.1, "val")


@query(f"SELECT conv_id, turn, CASE WHEN {sql_h("'ent'", 'CAST(conv_id AS VARCHAR)')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM conversations")
def o06_entity_split(s, d):
    return sampling.threshold_split(read(s, d, "conversations").select("conv_id", "turn"), "conv_id", 0.2, "ent")


@query("(SELECT doc_id, 'knowledge' AS role FROM documents WHERE lang = 'en') UNION ALL (SELECT doc_id, 'anchor' FROM documents WHERE lang <> 'en' ORDER BY sha256('mix|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM documents WHERE lang = 'en'))")
def o08_replay_mix(s, d):
    docs = _docs(s, d).select("doc_id", "lang")
    return sampling.replay_mix(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "doc_id", 0.25, "mix").select("doc_id", "role")


@query("""WITH f AS (SELECT doc_id, n_chars > 2000 AS long FROM documents) (SELECT doc_id FROM f WHERE NOT long) UNION ALL (SELECT doc_id FROM f WHERE long ORDER BY sha256('deb|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT CAST(floor(count(*) * 0.2 / 0.8) AS BIGINT) FROM f WHERE NOT long))""")
def o09_debias_downsample(s, d):
    return sampling.debias(_docs(s, d).select("doc_id", (F.col("n_chars") > 2000).alias("long")), "long", "doc_id", 0.2, "deb").select("doc_id")


# Aggregates and statistics.
_RUNS = f"{MCQ}, {sql_run('base')}, {sql_run('armx')}, {sql_run('army')}"


@query(f"""WITH {_RUNS}, u AS (SELECT 'subject' AS dimension, subject AS value, correct FROM base UNION ALL SELECT 'answer', CAST(answer AS VARCHAR), correct FROM base UNION ALL SELECT 'letter', letter, correct FROM base UNION ALL SELECT 'all', '', correct FROM base)
SELECT dimension, value, count(*) AS total, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, round(sum(CAST(correct AS INT)) / count(*), 4) AS accuracy FROM u GROUP BY ALL""")
def a01_accuracy_grouping_sets(s, d):
    return scoring.accuracy_by(run(s, d, "base"), ["subject", "answer", "letter"])


@query(f"WITH {_RUNS}, g AS (SELECT count(*) AS total, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(parse_failed AS INT)) AS BIGINT) AS parse_failures FROM base) SELECT *, round(correct / total, 6) AS accuracy, round(sqrt(correct / total * (1 - correct / total) / total), 6) AS stderr FROM g")
def a02_overall(s, d):
    return scoring.overall(run(s, d, "base"))


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), p AS (SELECT unnest([50, 90, 99]) AS percent)
SELECT lang, percent, n_chars FROM r, p WHERE i = round_even(percent / 100 * (n - 1), 0)""")
def a07_nearest_rank(s, d):
    return scoring.nearest_rank(_docs(s, d), "lang", "n_chars", [50, 90, 99])


@query(f"WITH {_RUNS}, b AS (SELECT *, {sql_h("'band'", 'sample_id')} AS v FROM base), c AS (SELECT CAST(v >= 0.25 AS INT) + CAST(v >= 0.5 AS INT) + CAST(v >= 0.9 AS INT) AS band, correct FROM b) SELECT band, count(*) AS total, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, round(sum(CAST(correct AS INT)) / count(*), 4) AS accuracy FROM c GROUP BY 1")
def a12_banded(s, d):
    return scoring.banded(run(s, d, "base").withColumn("v", T.h01("band", F.col("sample_id"))), "v", [0.25, 0.5, 0.9])


@query(f"WITH {MCQ} SELECT choices[1] || '|' || choices[3] AS key_id, count(*) AS n, count(DISTINCT answer) AS answers FROM mcq GROUP BY 1 HAVING count(DISTINCT answer) > 1")
def a16_contradictions(s, d):
    return scoring.contradictions(mcq(s, d), F.concat(F.col("choices")[0], F.lit("|"), F.col("choices")[2]), "answer")


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest({_terms('text')}) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def a17_vocab_top(s, d):
    return scoring.vocabulary(_docs(s, d), T.content_terms(F.col("text")), 50)


@query(f"WITH {_WORDS}, g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM dw) SELECT count(*) AS bigrams, count(DISTINCT g) AS distinct_bigrams, round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM g")
def a18_distinct_n(s, d):
    g = _docs(s, d).select(T.plain_words(F.col("text")).alias("w")).select(F.explode(T.shingles("w", 2)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("bigrams"), F.count("*").alias("distinct_bigrams")).withColumn("distinct_2", F.round(F.col("distinct_bigrams") / F.col("bigrams"), 6))


@query(f"WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (a.correct OR b.correct OR c.correct) AS any_right, count(*) FILTER (a.correct AND b.correct AND c.correct) AS all_right, count(*) FILTER (a.correct AND NOT b.correct AND NOT c.correct) AS only_base, count(*) FILTER (b.correct AND NOT a.correct AND NOT c.correct) AS only_armx, count(*) FILTER (c.correct AND NOT a.correct AND NOT b.correct) AS only_army FROM base a JOIN armx b USING (sample_id) JOIN army c USING (sample_id)")
def a21_union(s, d):
    return scoring.union_accuracy({a: run(s, d, a) for a in ("base", "armx", "army")}, "sample_id")


@query(f"WITH {_RUNS} SELECT answer, letter, count(*) AS n FROM base GROUP BY ALL")
def a25_confusion(s, d):
    return scoring.confusion(run(s, d, "base"))


_PAIR = "SELECT {0} count(*) AS n, CAST(sum(CAST(a.correct AS INT)) AS BIGINT) AS right_a, CAST(sum(CAST(b.correct AS INT)) AS BIGINT) AS right_b, count(*) FILTER (a.correct AND NOT b.correct) AS only_a, count(*) FILTER (b.correct AND NOT a.correct) AS only_b FROM base a JOIN armx b USING (sample_id) {1}"


@query(f"WITH {_RUNS}, p AS ({_PAIR.format('a.subject,', 'GROUP BY a.subject')}) SELECT *, round(100.0 * (right_b - right_a) / n, 4) AS delta_pp FROM p")
def x02_mcnemar_counts(s, d):
    return scoring.paired(run(s, d, "base"), run(s, d, "armx"), "sample_id", "subject").drop("p")


@query(f"""WITH {_RUNS}, g AS (SELECT subject, count(*) AS n, sum(CAST(correct AS INT)) AS k FROM base GROUP BY 1), w AS (SELECT subject, n, k / n AS p, 1.959963984540054 AS z FROM g)
SELECT subject, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS lo, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS hi FROM w""")
def x03_wilson(s, d):
    g = run(s, d, "base").groupBy("subject").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("subject", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_VOTE = f"""{MCQ}, {ROLL}, vc AS (SELECT sample_id, predicted, count(*) AS n, min(k) AS first FROM roll GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first) AS r FROM vc),
v AS (SELECT sample_id, max(CASE WHEN r = 1 THEN predicted END) AS winner, max(CASE WHEN r = 1 THEN n END) AS n1, coalesce(max(CASE WHEN r = 2 THEN n END), 0) AS n2, CAST(sum(n) AS BIGINT) AS total FROM vr GROUP BY 1),
voted AS (SELECT *, round(n1 / total, 6) AS share, round((n1 - n2) / total, 6) AS margin FROM v)"""


@query(f"""WITH {_VOTE}, g AS (SELECT sample_id, any_value(answer) AS answer, avg(CAST(predicted = answer AS INT)) AS rate FROM roll GROUP BY 1)
SELECT count(*) AS questions, round(avg(rate), 6) AS pass1, round(avg(CAST(rate > 0 AS INT)), 6) AS passk, round(avg(CAST(winner = answer AS INT)), 6) AS vote, count(*) FILTER (rate = 1) AS always, count(*) FILTER (rate = 0) AS never FROM g JOIN voted USING (sample_id)""")
def x04_pass_at_k(s, d):
    return voting.pass_at_k(rollouts(s, d))


@query(f"WITH {_RUNS}, p AS (SELECT a.correct AS a, b.correct AS b FROM base a JOIN armx b USING (sample_id)) SELECT count(*) FILTER (NOT a AND b) AS fixed, count(*) FILTER (a AND NOT b) AS broken, count(*) FILTER (NOT a AND NOT b) AS still_wrong, count(*) FILTER (NOT a AND b) - count(*) FILTER (a AND NOT b) AS net FROM p")
def x05_flips(s, d):
    return scoring.flips(run(s, d, "base"), run(s, d, "armx"), "sample_id")


@query(f"""WITH {_RUNS}, k AS (SELECT sample_id, CAST(a.correct AS INT) + CAST(b.correct AS INT) + CAST(c.correct AS INT) AS k FROM base a JOIN armx b USING (sample_id) JOIN army c USING (sample_id))
SELECT CASE k WHEN 3 THEN 'solid' WHEN 0 THEN 'hard' ELSE 'unstable' END AS class, count(*) AS n FROM k GROUP BY 1""")
def x06_stability(s, d):
    return scoring.stability([run(s, d, a) for a in ("base", "armx", "army")], "sample_id")


@query(f"""WITH {_RUNS}, u AS (SELECT 'gold_letter' AS feature, chr(65 + answer) AS bucket, correct FROM base UNION ALL SELECT 'subject', subject, correct FROM base UNION ALL SELECT 'gold_length', CASE WHEN length(choices[answer + 1]) < 8 THEN 'short' ELSE 'long' END, correct FROM base)
SELECT feature, bucket, count(*) AS total, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct FROM u GROUP BY ALL""")
def x07_buckets(s, d):
    gold = F.length(F.col("choices")[F.col("answer")])
    return scoring.bucket_table(run(s, d, "base"), {"gold_letter": T.letter(F.col("answer")), "subject": F.col("subject"), "gold_length": F.when(gold < 8, "short").otherwise("long")})


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a11_contingency(s, d):
    return read(s, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(f"""WITH {MCQ}, m AS (SELECT *, list_transform(choices, lambda c: length(c)) AS n FROM mcq) SELECT count(*) AS items, round(avg(1 / len(choices)), 6) AS random_baseline, round(max(share), 6) AS letter_baseline, max(longest) AS gold_longest
FROM (SELECT choices FROM m), (SELECT max(c) / sum(c) AS share FROM (SELECT answer, count(*) AS c FROM m GROUP BY 1)), (SELECT round(avg(CAST(n[answer + 1] = list_max(n) AS INT)), 6) AS longest FROM m)""")
def x21_profile(s, d):
    q = mcq(s, d).withColumn("n", F.transform("choices", F.length))
    letters = q.groupBy("answer").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("share"))
    facts = q.agg(F.count("*").alias("items"), F.round(F.avg(1 / F.size("choices")), 6).alias("random_baseline"), F.round(F.avg((F.col("n")[F.col("answer")] == F.array_max("n")).cast("double")), 6).alias("gold_longest"))
    return facts.crossJoin(letters).select("items", "random_baseline", F.round("share", 6).alias("letter_baseline"), "gold_longest")


# Votes, cascades, routing.
@query(f"WITH {_VOTE} SELECT sample_id, winner, n1, n2, total, share, margin FROM voted")
def v01_vote(s, d):
    return voting.votes(rollouts(s, d))


@query(f"WITH {_VOTE} SELECT sample_id, winner, share, margin FROM voted WHERE share >= 0.5")
def v02_share_margin(s, d):
    return v01_vote(s, d).where("share >= 0.5").select("sample_id", "winner", "share", "margin")


@query(f"""WITH {_VOTE} SELECT CASE WHEN share < 0.6 THEN 'uncertain' WHEN share >= 0.75 THEN CASE WHEN winner = answer THEN 'cons-right' ELSE 'cons-wrong' END WHEN winner = answer THEN 'mid-right' ELSE 'mid-wrong' END AS class, count(*) AS n FROM voted JOIN mcq USING (sample_id) GROUP BY 1""")
def v03_classes(s, d):
    return voting.classes(v01_vote(s, d), mcq(s, d))


@query(f"""WITH {_RUNS}, u AS (SELECT sample_id, choices[predicted + 1] AS said, 0 AS k FROM base WHERE letter <> '' UNION ALL SELECT sample_id, choices[predicted + 1], 1 FROM armx WHERE letter <> '' UNION ALL SELECT sample_id, choices[predicted + 1], 2 FROM army WHERE letter <> ''),
c AS (SELECT sample_id, said, count(*) AS n, min(k) AS f FROM u GROUP BY ALL) SELECT sample_id, said AS winner, n, CAST((sum(n) OVER (PARTITION BY sample_id)) AS BIGINT) AS total FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, f) = 1""")
def v04_text_majority(s, d):
    return voting.text_majority([run(s, d, a) for a in ("base", "armx", "army")])


_GATED = f"{_VOTE}, {sql_run('base')}, t AS (SELECT unnest([0.25, 0.5, 0.75]) AS tau)"


@query(f"WITH {_GATED} SELECT CAST(tau AS DOUBLE) AS tau, count(*) AS total, count(*) FILTER (CASE WHEN margin >= tau THEN winner ELSE predicted END = answer) AS correct, count(*) FILTER (margin < tau) AS deferred FROM voted JOIN base USING (sample_id), t GROUP BY 1")
def v05_gated_vote(s, d):
    return voting.gated(v01_vote(s, d), run(s, d, "base"), [0.25, 0.5, 0.75])


@query(f"""WITH {_RUNS}, u AS (SELECT subject, 'base' AS name, correct FROM base UNION ALL SELECT subject, 'armx', correct FROM armx UNION ALL SELECT subject, 'army', correct FROM army), g AS (SELECT subject, name, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS r, count(*) AS n FROM u GROUP BY ALL)
SELECT subject AS slice, name AS best, r AS best_right, n, round(sqrt(r / n * (1 - r / n) / n) * sqrt(2 * ln(3)), 6) AS chance_gain FROM g QUALIFY row_number() OVER (PARTITION BY subject ORDER BY r DESC, name) = 1""")
def v07_routing(s, d):
    return voting.routing({a: run(s, d, a) for a in ("base", "armx", "army")}, "subject")


@query(f"WITH {_RUNS} SELECT count(*) AS n, count(*) FILTER (a.predicted = b.predicted AND b.predicted = c.predicted) AS agreed, count(*) FILTER (a.predicted = b.predicted AND b.predicted = c.predicted AND a.predicted = a.answer) AS agreed_right FROM base a JOIN armx b USING (sample_id) JOIN army c USING (sample_id)")
def v08_agreement(s, d):
    return voting.agreement([run(s, d, a) for a in ("base", "armx", "army")])


@query(f"""WITH {MCQ}, {sql_run('base')}, r AS (SELECT *, CASE WHEN correct THEN (answer + 1 + {sql_byte("'pref|' || sample_id")} % 3) % 4 ELSE predicted END AS x FROM base WHERE NOT parse_failed) SELECT sample_id, CASE WHEN correct THEN 'anchor' ELSE 'error' END AS kind, choices[answer + 1] AS chosen, choices[x + 1] AS rejected FROM r""")
def v09_preference_pairs(s, d):
    return voting.preference_pairs(run(s, d, "base"), "pref")


# Chunks.
@query(f"WITH {_WIN} SELECT doc_id, start, win_id, text FROM win")
def k05_windows(s, d):
    return contamination.windows(_docs(s, d))


# Joins and sets.
@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j04_semi(s, d):
    return _docs(s, d).select("doc_id").join(read(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j05_anti(s, d):
    return read(s, d, "customer").join(read(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"WITH {_EDGES} SELECT doc_id, item_id FROM edges")
def j08_edges(s, d):
    return contamination.scan(_docs(s, d), _items(s, d))


@query(f"""WITH {_ITERMS}, z AS (SELECT item_id, count(*) AS n FROM it GROUP BY 1), p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS n FROM it a JOIN it b ON a.term = b.term AND a.item_id < b.item_id GROUP BY ALL)
SELECT a, b, round(p.n / (x.n + y.n - p.n), 6) AS jaccard FROM p JOIN z x ON a = x.item_id JOIN z y ON b = y.item_id WHERE p.n / (x.n + y.n - p.n) >= 0.05""")
def j13_jaccard_pairs(s, d):
    t = contamination.item_terms(_items(s, d))
    z = t.groupBy("item_id").agg(F.count("*").alias("n"))
    p = t.withColumnRenamed("item_id", "a").join(t.withColumnRenamed("item_id", "b"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    p = p.join(z.toDF("a", "na"), "a").join(z.toDF("b", "nb"), "b").withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    return p.where("jaccard >= 0.05").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("""WITH a AS (SELECT doc_id, quality + 10 AS v FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic + 20 AS v FROM labels WHERE toxic = 1 OR quality = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS v, CASE WHEN b.doc_id IS NULL THEN 'a' WHEN a.doc_id IS NULL THEN 'b' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j14_full_merge(s, d):
    t = read(s, d, "labels")
    return joins.full_merge(t.where("quality = 1").select("doc_id", (F.col("quality") + 10).alias("v")), t.where("toxic = 1 OR quality = 0").select("doc_id", (F.col("toxic") + 20).alias("v")), "doc_id", "v")


@query(f"WITH {_RUNS}, r AS (SELECT * FROM armx WHERE answer = 0) SELECT base.sample_id, coalesce(r.predicted, base.predicted) AS predicted, coalesce(r.correct, base.correct) AS correct FROM base LEFT JOIN r USING (sample_id)")
def j16_upsert(s, d):
    cols = ["sample_id", "predicted", "correct"]
    return joins.upsert(run(s, d, "base").select(*cols), run(s, d, "armx").where("answer = 0").select(*cols), "sample_id")


@query("SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents), 6) AS rate")
def j03_hit_rate(s, d):
    return joins.hit_rate(_docs(s, d), read(s, d, "labels"), "doc_id")


# Incremental and streams.
@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'view' AND value IS NOT NULL)")
def s14_resume_append(s, d):
    """Of all events those that are views, or that failed (have no value), are still to do."""
    e = read(s, d, "events")
    done = e.where("event_type <> 'view'").select("event_id", F.when(F.col("value").isNull(), "failed").alias("error"))
    return joins.resume(e, done, "event_id").select("event_id")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def i01_stream_dedup(s, d):
    once = appends.deduplicated(appends.read_events(s, d)).select("event_id", "event_type")
    return appends.run_to_end(once, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM events GROUP BY 1")
def j_last_wins(s, d):
    e = read(s, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id")).join(n, "event_type").select("event_type", "last_id", "n")


# Answerers without a model.
@query(f"WITH {MCQ} SELECT count(*) AS total, count(*) FILTER (answer = 0) AS always_a, count(*) FILTER (CAST(list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1 AS INTEGER) = answer) AS heuristic FROM mcq")
def m04_baselines(s, d):
    n = F.size("choices")
    right = T.parse_letter(F.col("completion"), n) == T.letter(F.col("answer"))
    a = scorers.constant(mcq(s, d), "A").withColumn("a", right)
    return scorers.heuristic(a).withColumn("h", right).agg(F.count("*").alias("total"), F.count_if("a").alias("always_a"), F.count_if("h").alias("heuristic"))


# Relational regression over the star schema; not in the surveyed workload.
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def e01_pricing_summary(s, d):
    li = read(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def e02_revenue_by_nation(s, d):
    j = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
