"""Registered queries of normalisers, parsers, prompts, views, chunks, files and samples; they join the catalog's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..operators import chunking, dedup, gates, joins, sampling, views
from ..sources import io, scorers, scratch
from .catalog import _W, _docs, _items, _US, query
from .catalog_gates import _LOW, _WS, _sq
from .derived import ITEMS, MCQ, ROLL, SAID, completions, items, mcq, read, rollouts, sql_byte, sql_run


# Normalisers, each on texts that are made to show its own way.
def _torn(d):
    """A tag inside the first word, and odd white space at the end."""
    return d.withColumn("text", F.concat(F.substring("text", 1, 1), F.lit("[a tag]"), F.expr("substring(text, 2)"), F.lit(" \u2003\x1c\n")))


_SP = "trim(regexp_replace({0}, '" + _US.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(lower({_SP.format('text')})) AS digest FROM documents")
def p01_norm_tag_del(s, d):
    return _torn(_docs(s, d)).select("doc_id", F.md5(T.norm_tag_deleted(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(lower({_SP.format("substr(text, 1, 1) || ' ' || substr(text, 2)")})) AS digest FROM documents")
def p02_norm_tag_sp(s, d):
    return _torn(_docs(s, d)).select("doc_id", F.md5(T.norm_tag_spaced(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_SP.format("substr(text, 1, 1) || '[a tag]' || substr(text, 2)")}) AS digest FROM documents")
def p03_norm_ws(s, d):
    return _torn(_docs(s, d)).select("doc_id", F.md5(T.norm_ws(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_ \t\n\r\f\v.\-]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM documents")
def p05_norm_punct(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.norm_punct(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, {_LOW.format('text')} || ' fi 1 ab 2 ...' AS text FROM documents")
def p06_norm_nfkc(s, d):
    """Texts with characters that compatibility composition takes apart at their end."""
    odd = F.lit(" \ufb01 \u2460 \uff21\uff22 \u00b2 \u2026")
    return _docs(s, d).select("doc_id", T.norm_nfkc(F.concat("text", odd)).alias("text"))


# Parsers.
_KITX = {0: "@", 1: "@", 2: "@", 7: "@", 8: "@", 9: "@", 10: "@", 11: "@", 16: "E", 17: "@", 18: "@"}


def _cases(found: dict[int, str], other: str) -> str:
    return "CASE w.way " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in found.items()) + f" ELSE '{other}' END"


@query(f"""WITH {SAID}, w AS (SELECT comp.*, {sql_byte("'c|' || sample_id")} % 22 AS way FROM comp),
x AS (SELECT sample_id, predicted, CASE WHEN way IN (0, 1, 2, 7, 8, 9, 10, 11, 17, 18) THEN predicted ELSE -1 END AS kit, replace({_cases(_KITX, "?")}, '@', chr(65 + predicted)) AS judged FROM w)
SELECT sample_id, kit, judged FROM x""")
def p11_kit_parser(s, d):
    c = completions(s, d)
    return c.select("sample_id", T.parse_kit(F.col("completion"), F.size("choices")).alias("kit"), T.parse_abstaining(F.col("completion")).alias("judged"))


# Prompts, rotations, views.
_LINES = "'A) ' || choices[1] || chr(10) || 'B) ' || choices[2] || chr(10) || 'C) ' || choices[3] || chr(10) || 'D) ' || choices[4]"


@query(f"""WITH {MCQ}, p AS (SELECT *, 'Which one?' || chr(10) || {_LINES} AS plain, replace('Which one?' || chr(10) || {_LINES}, chr(65 + answer) || ') ' || choices[answer + 1], chr(65 + answer) || ') [MASK]') AS masked FROM mcq)
SELECT sample_id, 'Think step by step; the last line is ANSWER: and one of A,B,C,D.' || chr(10) || chr(10) || plain AS steps, 'Which is first?' || chr(10) || 'A) one' || chr(10) || 'B) two' || chr(10) || 'ANSWER: A' || chr(10) || chr(10) || plain AS example,
'Is this true? Reply YES or NO.' || chr(10) || chr(10) || 'Which one?' || chr(10) || choices[answer + 1] AS verify, 'Reference note:' || chr(10) || 'about ' || subject || chr(10) || chr(10) || plain AS note,
'Reference material.' || chr(10) || chr(10) || '[1] about ' || subject || chr(10) || chr(10) || '---' || chr(10) || chr(10) || plain AS windows, masked FROM p""")
def p14_prompt_variants(s, d):
    made = views.prompts(F.lit("Which one?"), F.col("choices"), F.col("answer"), F.concat(F.lit("about "), "subject"))
    return mcq(s, d).select("sample_id", *[c.alias(n) for n, c in made.items()])


@query(f"""WITH {MCQ}, c AS (SELECT sample_id, 'own' AS convention, {sql_byte('sample_id')} % 4 AS shift, choices, answer FROM mcq UNION ALL SELECT sample_id, 'salted', {sql_byte("'salt:' || sample_id")} % 4, choices, answer FROM mcq UNION ALL SELECT sample_id, 'every', CAST(unnest(range(4)) AS INTEGER), choices, answer FROM mcq)
SELECT sample_id, convention, shift, array_to_string([choices[(i + shift) % 4 + 1] for i in range(4)], '|') AS choices, choices[answer + 1] AS gold FROM c
UNION ALL SELECT sample_id, 'right', 1, array_to_string([choices[4], choices[1], choices[2], choices[3]], '|'), choices[answer + 1] FROM mcq""")
def p15_rotation_conventions(s, d):
    """What stands at the rotated answer's place is the gold, whatever the convention."""
    return views.rotations(mcq(s, d)).select("sample_id", "convention", "shift", F.array_join("choices", "|").alias("choices"), F.col("choices")[F.col("answer")].alias("gold"))


@query(f"""WITH {MCQ}, {ROLL}, r AS (SELECT roll.sample_id, k, roll.predicted AS shown, [choices[(i + 4 - k % 4) % 4 + 1] for i in range(4)] AS lefted, choices FROM roll JOIN mcq USING (sample_id))
SELECT sample_id, k, lefted[shown + 1] AS said FROM r""")
def p16_unrotate_vote(s, d):
    """Options are shown rotated to the right by k; the text that a shown letter names is found through its original place."""
    r = rollouts(s, d).join(mcq(s, d).select("sample_id", "choices"), "sample_id").withColumn("original", F.expr("pmod(predicted - k % 4, 4)"))
    return r.select("sample_id", "k", F.col("choices")[F.col("original")].alias("said"))


@query(f"WITH {MCQ} SELECT sample_id, md5({_LOW.format("'What is  ' || subject")} || '|' || array_to_string(list_sort(list_transform(choices, lambda c: {_LOW.format('c')})), '|')) AS content_key FROM mcq")
def p18_item_keys(s, d):
    return mcq(s, d).select("sample_id", T.content_key(F.concat(F.lit("What is  "), "subject"), F.col("choices")).alias("content_key"))


_TAGS = [("[3GPP Release 17]", "3gpp", "3GPP", "17"), ("[IEEE 802.11]", "ieee", "IEEE 802.11", "NULL"), ("[TCP/IP]", "tcpip", "TCP/IP", "NULL"), ("[x] as RFC 791 says", "tcpip", "x", "NULL"), ("in release 15?", "3gpp", "(no tag)", "NULL"), ("[a][some other tag that is long]", "untagged", "some other tag that is l", "NULL"), ("", "untagged", "(no tag)", "NULL")]


@query("WITH t(way, tag, bucket, last, rel) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', CAST({r} AS INTEGER))" for i, (a, b, c, r) in enumerate(_TAGS)) + f") SELECT item_id, bucket, last AS tag, rel AS release FROM benchmark JOIN t ON way = item_id % {len(_TAGS)}")
def p21_provenance_tags(s, d):
    tag = F.array(*[F.lit(t) for t, *_ in _TAGS])[F.pmod("item_id", F.lit(len(_TAGS))).cast("int")]
    q = _items(s, d).withColumn("q", F.concat("text", F.lit(" "), tag))
    return q.select("item_id", T.bucket(F.col("q")).alias("bucket"), T.last_tag(F.col("q")).alias("tag"), T.release(F.col("q")).alias("release"))


_SET = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(f"""WITH {ITEMS}, f AS (SELECT *, len(choices) AS n, list_transform(choices, lambda c: length(c)) AS l, list_transform(choices, lambda c: {_SET.format('c')}) AS w, {_SET.format('question')} AS qw FROM items),
g AS (SELECT *, list_transform(w, lambda x: len(list_intersect(x, qw))) AS o, list_transform(range(len(w)), lambda i: list_transform(range(len(w)), lambda j: i < j AND len(list_distinct(list_concat(w[i + 1], w[j + 1]))) > 0 AND len(list_intersect(w[i + 1], w[j + 1])) >= 0.7 * len(list_distinct(list_concat(w[i + 1], w[j + 1]))))) AS near FROM f)
SELECT item_id, n AS n_options, len(list_filter(choices, lambda c: regexp_matches(c, '{_sq(views.CATCH_ALL)}'))) > 0 AS catch_all, len(list_filter(choices, lambda c: regexp_matches(c, '[0-9]'))) >= greatest(2, n - 1) AS numeric, regexp_matches(question, '{_sq(views.NEGATED)}') AS negated,
l[gold + 1] = list_max(l) AS gold_longest, l[gold + 1] = list_min(l) AS gold_shortest, round(list_max(l) / greatest(1, list_min(l)), 6) AS length_ratio, list_contains(flatten(near), true) AS near_duplicates,
CASE WHEN list_max(o) > 0 AND len(list_filter(o, lambda x: x = list_max(o))) = 1 THEN CAST(list_position(o, list_max(o)) - 1 AS INTEGER) END AS overlap_option, o[gold + 1] = list_max(o) AND list_max(o) > 0 AS gold_overlap FROM g""")
def p22_item_features(s, d):
    names = ["n_options", "catch_all", "numeric", "negated", "gold_longest", "gold_shortest", "length_ratio", "near_duplicates", "overlap_option", "gold_overlap"]
    return views.item_shape(items(s, d)).select("item_id", *names)


def _ceiling(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.CEILING_STOP)
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9.\\-]{{2,}}'), lambda x: NOT list_contains([{stop}], x)))"


@query(f"""WITH {ITEMS}, g AS (SELECT *, {_ceiling('evidence')} AS e, {_ceiling('answer')} AS g FROM items), s AS (SELECT item_id, g, len(list_intersect(g, e)) / len(g) AS gv, coalesce(list_max(list_transform(distractors, lambda x: CASE WHEN len({_ceiling('x')}) > 0 THEN len(list_intersect({_ceiling('x')}, e)) / len({_ceiling('x')}) ELSE 0 END)), 0) AS best FROM g)
SELECT item_id, CASE WHEN len(g) = 0 THEN 0 ELSE round_even(gv, 4) END AS coverage, CASE WHEN len(g) = 0 THEN 0 ELSE round_even(gv - greatest(0, best), 4) END AS giveaway FROM s""")
def p26_giveaway(s, d):
    coverage, score = T.giveaway(F.col("evidence"), F.col("answer"), F.col("distractors"))
    return items(s, d).select("item_id", coverage.alias("coverage"), score.alias("giveaway"))


_RAW = [
    ('Sure:\n```json\n[{"a": 1}, {"a": 2}]\n``` done', 2), ('[{"a": "]["}, {"b": 2}] trailing ]', 2), ("no list at all", 0), ('think [x] then [{"a": 1}]', 1), ('{"a": 1}\n{"a": 2}\n{"a": 3}', 3), ('[{"a": 1}, {"cut": ', 1),
    ('```\n[1, 2, 3, 4]\n```', 4), ('first [1 2] and {"z": "}"} and {"y": 1}', 2), (None, 0), ('[{"q": "a \\"quoted\\" ]"}]', 1),
]


@query("WITH n(way, n) AS (VALUES " + ", ".join(f"({i}, {n})" for i, (_, n) in enumerate(_RAW)) + f") SELECT event_id, n AS objects FROM events JOIN n ON way = event_id % {len(_RAW)}")
def p29_json_recovery(s, d):
    raw = F.array(*[F.lit(t) for t, _ in _RAW])[F.pmod("event_id", F.lit(len(_RAW))).cast("int")]
    e = read(s, d, "events").select("event_id", views.recovered_json(raw).alias("j"))
    return e.select("event_id", F.coalesce(F.json_array_length("j"), F.lit(0)).alias("objects"))


_CLEAN = "regexp_replace(" + _WS.format("regexp_replace({0}, '[*_`$#]+', '', 'g')") + ", '[. ]+$', '')"


@query(f"""WITH {ITEMS}, c AS (SELECT *, {_CLEAN.format('evidence')} AS e, {_CLEAN.format('answer')} AS a FROM items), p AS (SELECT *, instr(lower(e), lower(a)) AS pos, question || chr(10) || array_to_string(list_transform(range(len(choices)), lambda i: chr(CAST(65 + i AS INTEGER)) || ') ' || choices[i + 1]), chr(10)) AS options FROM c)
SELECT item_id, 'qa' AS "view", 'Answer in one short phrase.' || chr(10) || chr(10) || question AS prompt, CASE WHEN pos > 0 THEN e ELSE e || '. ' || a END || '.' AS completion FROM p
UNION ALL SELECT item_id, 'reverse', 'It is stated: ' || e || '.' || chr(10) || chr(10) || 'What question does this answer?', question FROM p
UNION ALL SELECT item_id, 'statement', 'State what settles this: ' || question, CASE WHEN pos > 0 THEN e ELSE e || '. In short: ' || a END || '.' FROM p
UNION ALL SELECT item_id, 'cloze', 'Complete this. Reply with the missing text only.' || chr(10) || chr(10) || substr(e, 1, pos - 1) || '____' || substr(e, pos + length(a)), a FROM p WHERE pos > 0 AND length(a) >= 3
UNION ALL SELECT item_id, 'mcq', options, e || '. ' || array_to_string(list_transform(list_filter(range(len(choices)), lambda i: i <> gold), lambda i: chr(CAST(65 + i AS INTEGER)) || ') ' || choices[i + 1] || ' is wrong.'), ' ') || ' ANSWER: ' || chr(65 + gold) FROM p""")
def p32_views(s, d):
    return views.rendered(items(s, d))


_PARA = ["", "How are ABC-1 and [tag] used now?\nNow.", "what is abc-1 used [tag] for", "Say?", "What purpose does ABC-1 serve here?", "For what is [tag] abc used, in short words?", "Which option A is ABC-1 used for [tag]?", "For what purpose is ABC-1 [tag] in use?"]
_PWHY = ["empty", "multiline", "identical", "length_ratio", "lost_tag", "lost_acronym", "leaks_answer_language", "fine"]


@query("WITH n(way, r) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(_PWHY)) + f") SELECT item_id, r AS reason FROM benchmark JOIN n ON way = item_id % {len(_PARA)}")
def p33_paraphrase_reason(s, d):
    new = F.array(*map(F.lit, _PARA))[F.pmod("item_id", F.lit(len(_PARA))).cast("int")]
    reason = views.paraphrase_reason(F.lit("What is ABC-1 used [tag] for?"), new)
    return _items(s, d).select("item_id", F.coalesce(reason, F.lit("fine")).alias("reason"))


@query(f"""WITH {ITEMS}, t AS (SELECT item_id, text, answer, instr(lower(text), lower(answer)) AS pos FROM items JOIN documents ON doc_id = chunk_id), b AS (SELECT item_id, substr(text, 1, pos - 1) AS b FROM t WHERE pos > 0),
c AS (SELECT item_id, trim(regexp_replace(b, '^(?s:.*)(\\n|\\. )', ''), ' ' || chr(9) || chr(10) || chr(13)) AS prefix FROM b) SELECT item_id, prefix FROM c WHERE length(prefix) >= 15""")
def p35_span_prefix(s, d):
    t = items(s, d).join(_docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return t.select("item_id", T.span_prefix(F.col("text"), F.col("answer")).alias("prefix")).where("prefix IS NOT NULL")


# Structure: documents whose sections are known, because they were made of their words.
def _parts(s, d):
    w = _docs(s, d).select("doc_id", T.plain_words(F.regexp_replace("text", "[#.*|0-9]", "")).alias("w"))
    return w.select("doc_id", *[F.array_join(F.slice("w", 1 + 5 * i, 5), " ").alias(f"p{i}") for i in range(4)])


_PARTS = f"""pw AS (SELECT doc_id, list_filter({_W.format("regexp_replace(text, '[#.*|0-9]', '', 'g')")}, lambda x: x <> '') AS w FROM documents),
parts AS (SELECT doc_id, {", ".join(f"array_to_string(w[{1 + 5 * i}:{5 + 5 * i}], ' ') AS p{i}" for i in range(4))} FROM pw)"""


@query(f"""WITH {_PARTS} SELECT doc_id, '1 Scope' AS trail, p0 AS text FROM parts UNION ALL SELECT doc_id, '1 Scope > Alpha ' || CAST(doc_id AS VARCHAR), p1 || chr(10) || 'more' FROM parts
UNION ALL SELECT doc_id, 'Beta', p2 FROM parts UNION ALL SELECT doc_id, 'Beta > Deep', p3 FROM parts""")
def k01_sections(s, d):
    id_ = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Cover\nnot this\n## **1 Scope**\n"), "p0", F.lit("\n### Alpha "), id_, F.lit("\n"), "p1", F.lit("\n![a figure](x.png) \nmore\n## Beta\n"), "p2", F.lit("\n#### Deep\n"), "p3", F.lit("\n# Empty"))
    found = chunking.sections(_parts(s, d).select("doc_id", text.alias("text")), start=chunking.SCOPE_HEADING, drop=chunking.IMAGE)
    return found.select("doc_id", F.array_join("trail", " > ").alias("trail"), "text")


@query(f"""WITH {_PARTS}, q AS (SELECT doc_id, trim(p0) AS p0, trim(p1) AS p1, trim(p2) AS p2 FROM parts) SELECT doc_id, '1 Scope of this' AS heading, CASE WHEN p0 = '' THEN 'x' ELSE p0 || chr(10) || 'x' END AS text FROM q
UNION ALL SELECT doc_id, '5.2 Alpha beta', CASE WHEN p1 = '' THEN '' ELSE p1 || chr(10) END || '5.2 dB is the target of a line that has far more words than headings have' FROM q UNION ALL SELECT doc_id, 'Annex A: Extra', p2 FROM q WHERE p2 <> ''""")
def k02_clauses(s, d):
    text = F.concat(F.lit("Foreword\nthis goes\n1 Scope of this\n\n"), "p0", F.lit("\nx\n5.1 Contents ....... 12\n5.2 Alpha  beta\n"), "p1", F.lit("\n5.2 dB is the target of a line that has far more words than headings have\nAnnex A: Extra\n"), "p2")
    return chunking.clauses(_parts(s, d).select("doc_id", text.alias("text"))).select("doc_id", "heading", "text")


@query("""SELECT doc_id, CAST(15 + doc_id % 4 AS INTEGER) AS release, CAST(20 + doc_id % 10 AS VARCHAR) || '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS by_path, CAST(20 + doc_id % 10 AS VARCHAR) || '.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS by_file FROM documents""")
def k04_spec_identity(s, d):
    part = lambda a, n: F.lpad((F.lit(a) + F.col("doc_id") % n).cast("string"), 2 if a else 3, "0")
    series, number = part(20, 10), part(0, 1000)
    path = F.concat(F.lit("marked/Rel-"), (15 + F.col("doc_id") % 4).cast("string"), F.lit("/"), series, F.lit("_series/"), series, number, F.lit("/raw.md"))
    release, spec = chunking.spec_of_path(path)
    return _docs(s, d).select("doc_id", release.alias("release"), spec.alias("by_path"), chunking.spec_of_file(F.when(F.col("doc_id") % 3 > 0, series), F.concat(series, number, F.lit("-i20"))).alias("by_file"))


_HEADED = f"""md AS (SELECT doc_id, [list_concat(['#', 'one'], w[1:30]), list_concat(['##', 'two'], w[31:37]), list_concat(['###', 'three'], w[38:90])] AS secs FROM (SELECT doc_id, list_filter({_W.format("regexp_replace(text, '[#]', '', 'g')")}, lambda x: x <> '') AS w FROM documents)),
sec AS (SELECT doc_id, unnest(range(3)) AS part, unnest(secs) AS w FROM md), pc AS (SELECT doc_id, part, w, unnest(range(0, len(w), 20)) AS f FROM sec),
pn AS (SELECT doc_id, w[f + 1:f + 20] AS w, row_number() OVER (PARTITION BY doc_id ORDER BY part, f) AS i FROM pc)"""


@query(f"""WITH RECURSIVE {_HEADED}, b AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS bin, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM pn)
UNION ALL SELECT b.doc_id, pn.i, CASE WHEN b.n >= 14 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.n >= 14 THEN 0 ELSE b.n END + len(pn.w) FROM b JOIN pn ON pn.doc_id = b.doc_id AND pn.i = b.i + 1)
SELECT b.doc_id, bin AS chunk, CAST(sum(len(w)) AS BIGINT) AS words, string_agg(array_to_string(w, ' '), chr(10) ORDER BY b.i) AS text FROM b JOIN pn USING (doc_id, i) GROUP BY ALL HAVING sum(len(w)) >= 10""")
def k07_heading_chunks(s, d):
    w = _docs(s, d).select("doc_id", T.plain_words(F.regexp_replace("text", "#", "")).alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    text = F.concat(F.lit("# one\n"), part(1, 30), F.lit("\n## two "), part(31, 7), F.lit("\n### three\n"), part(38, 53))
    return chunking.heading_chunks(w.select("doc_id", text.alias("text")), 20, 10)


@query(f"WITH {_PARTS} SELECT doc_id, i AS place, [p0 || ' [2] x', p1 || ' end', p2 || ' ' || p3][i] AS text FROM (SELECT parts.*, CAST(unnest([1, 2, 3]) AS INTEGER) AS i FROM parts) WHERE trim(p0) <> '' AND trim(p3) <> ''")
def k08_prompt_windows(s, d):
    """A marker counts at a line's begin only, and the question after the rule is no window."""
    p = _parts(s, d).where("trim(p0) <> '' AND trim(p3) <> ''")
    text = F.concat(F.lit("Refer to these.\n\n[1] "), "p0", F.lit(" [2] x\n\n[2] "), "p1", F.lit(" end\n\n[3] "), "p2", F.lit(" "), "p3", F.lit(views.RULE), F.lit("[4] is the question?"))
    return chunking.prompt_windows(p.select("doc_id", text.alias("prompt")), "prompt", "doc_id")


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), n AS (SELECT doc_id, i, len(list_filter({_W.format('line')}, lambda x: x <> '')) AS words FROM l),
b AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, 0 AS bin, CAST(0 AS BIGINT) AS t FROM documents UNION ALL SELECT b.doc_id, n.i, CASE WHEN b.t > 0 AND (b.t >= 100 OR b.t + n.words > 160) THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.t > 0 AND (b.t >= 100 OR b.t + n.words > 160) THEN 0 ELSE b.t END + n.words FROM b JOIN n ON n.doc_id = b.doc_id AND n.i = b.i + 1)
SELECT doc_id, bin AS chunk, CAST(sum(words) AS BIGINT) AS words FROM b JOIN n USING (doc_id, i) GROUP BY ALL""")
def w12_pack(s, d):
    """Lines of documents as sections, packed to chunks of about 100 words."""
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "text"))
    return chunking.packed(lines, 100, 160).select("doc_id", "chunk", "words")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split({_SP.format('text')}, ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, w, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS t, -1 AS place FROM w WHERE len(w) > 0
  UNION ALL SELECT doc_id, w, t, CASE WHEN t + 40 >= len(w) THEN len(w) ELSE t + coalesce(list_max(list_filter(list_transform(w[t + 1:t + 40], lambda x, i: CASE WHEN i > 20 AND ends_with(x, '.') THEN i END), lambda i: i IS NOT NULL)), 40) END, place + 1 FROM b WHERE t < len(w))
SELECT doc_id, place, t - f AS words, array_to_string(w[f + 1:t], ' ') AS text FROM b WHERE place >= 0""")
def w16_segments(s, d):
    return chunking.segments(_docs(s, d), 40).select("doc_id", "place", F.col("words").cast("long").alias("words"), "text")


# Samples.
@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('win|' || CAST(doc_id AS VARCHAR)), doc_id) <= floor(0.05 * count(*) OVER (PARTITION BY source)) AS held FROM documents""")
def o07_held_out(s, d):
    return sampling.held_out(_docs(s, d).select("doc_id", "source"), "source", "doc_id", "win", 0.05).select("doc_id", "held")


@query("""WITH n AS (SELECT floor(0.1 * count(*)) AS n FROM documents WHERE lang IN ('en', 'de')) SELECT doc_id, CASE lang WHEN 'en' THEN 'real' ELSE 'teaches' END AS role FROM documents WHERE lang IN ('en', 'de')
UNION ALL (SELECT doc_id, 'anchor' FROM documents WHERE lang NOT IN ('en', 'de') ORDER BY sha256('arm|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT CAST(n AS BIGINT) FROM n))""")
def o10_training_arms(s, d):
    docs = _docs(s, d).select("doc_id", "lang")
    return sampling.arms(docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("lang NOT IN ('en', 'de')"), "doc_id", "arm", 0.1).select("doc_id", "role")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 64 OFFSET 128")
def o13_row_slice(s, d):
    return sampling.slice_rows(_docs(s, d).select("doc_id"), "doc_id", 128, 64, 32)


@query("""WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT i + i // 7 AS place, 'row' AS kind, doc_id AS id FROM r UNION ALL SELECT r.i + 1 + r.i // 7, 'anchor', item_id FROM r JOIN a ON a.i = (r.i // 7) % a.n WHERE r.i % 7 = 6""")
def w15_interleaved(s, d):
    return dedup.interleaved(_docs(s, d).select("doc_id"), "doc_id", _items(s, d).select("item_id"), "item_id", 7)


# Files: tables are written to the shared folder and read back.
_EVENT = "event_id long, user_id long, event_type string, props string"


def _put(df, name):
    path = scratch.new_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("SELECT event_id, user_id, event_type, props FROM events")
def s01_jsonl_strict(s, d):
    path = scratch.new_path(s, "events")
    io.write_jsonl(read(s, d, "events").select("event_id", "user_id", "event_type", "props"), path)
    return io.read_jsonl(s, path, Y._parse_datatype_string(_EVENT), strict=True)


@query("SELECT count(*) FILTER (event_id % 9 <> 4) AS good, count(*) FILTER (event_id % 9 = 4) AS bad, CAST(sum(event_id) FILTER (event_id % 9 <> 4) AS BIGINT) AS ids FROM events")
def s02_jsonl_tolerant(s, d):
    """One line in nine is cut."""
    row = F.to_json(F.struct("event_id", "user_id", "event_type", "props"))
    lines = read(s, d, "events").select(F.when(F.col("event_id") % 9 == 4, F.substr(row, F.lit(1), F.length(row) - 3)).otherwise(row).alias("value"))
    got = io.read_jsonl(s, _put(lines, "tolerant"), Y._parse_datatype_string(_EVENT))
    bad = F.col("_corrupt_record").isNotNull()
    return got.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.sum(F.when(~bad, F.col("event_id"))).alias("ids"))


def _document(rows, shape):
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))))
    keyed = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct("n_nationkey", "n_name")))))
    text = {"list": listed, "keyed": keyed, "envelope": F.concat(F.lit('{"summary": {"n": 25}, "results": '), listed, F.lit("}"))}[shape]
    return rows.groupBy().agg(text.alias("value"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def s03_json_document(s, d):
    """A list, and an object of rows."""
    row = Y._parse_datatype_string("n_nationkey long, n_name string")
    n = read(s, d, "nation")
    return io.read_results(s, _put(_document(n, "list"), "list"), row).unionByName(io.read_results(s, _put(_document(n, "keyed"), "keyed"), row))


@query("SELECT n_nationkey, n_name FROM nation")
def s04_result_envelope(s, d):
    return io.read_results(s, _put(_document(read(s, d, "nation"), "envelope"), "envelope"), Y._parse_datatype_string("n_nationkey long, n_name string"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def s06_shard_directory(s, d):
    """Shards with more columns than are asked for; the text is under one of its names."""
    path = scratch.new_path(s, "shards")
    _docs(s, d).withColumnRenamed("text", "content").repartition(5).write.parquet(path)
    df = s.read.parquet(path)
    return df.select("doc_id", F.md5(io.text_column(df)).alias("digest"))


@query("SELECT CAST(item_id AS VARCHAR) AS name, text FROM benchmark")
def s07_text_folder(s, d):
    path = scratch.new_path(s, "folder")
    rows = _items(s, d).select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("value"))
    rows.repartition(F.col("name")).write.partitionBy("name").text(path, lineSep="\n")
    got = io.read_text_folder(s, path, "*.txt")
    return got.select(F.regexp_extract("path", "name=(.+)/", 1).alias("name"), F.regexp_replace("text", "\n$", "").alias("text"))


@query("SELECT conv_id, turn, role || ' ' || chr(10) || ' ' || coalesce(text, '') || ' ' || chr(10) || ' ' AS blob FROM conversations")
def s08_record_blob(s, d):
    return read(s, d, "conversations").withColumn("none", F.lit(None).cast("string")).select("conv_id", "turn", io.blob("role", "text", "none").alias("blob"))


@query("SELECT 'content' AS first, 'text' AS second, 'body' AS third")
def s09_column_discovery(s, d):
    """The first of the known names that a table has."""
    names = [io.text_column(s.createDataFrame([], x)) for x in ("body string, content string", "content string, text string", "a int, body string")]
    return s.createDataFrame([tuple(names)], "first string, second string, third string")


@query(f"WITH {_PARTS} SELECT doc_id, CAST(i AS INTEGER) AS page, CASE WHEN i = 2 THEN 'own line' || chr(10) ELSE '' END || 'page ' || CAST(i AS VARCHAR) || ' ' || [p0, p1, p2, p3][i] || 'joined' || repeat('x', i) || chr(10) || 'end ' || CAST(i AS VARCHAR) AS text FROM (SELECT parts.*, unnest([1, 2, 3, 4]) AS i FROM parts)")
def s10_running_lines(s, d):
    """Four pages a document, with a header and a footer on each, a line of one page's own, and a word hyphenated over lines."""
    pages = _parts(s, d).select("doc_id", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("page"), "p")
    own = F.when(F.col("page") == 2, F.lit("own line\n")).otherwise("")
    n = F.col("page").cast("string")
    text = F.concat(F.lit("A Running Header\n"), own, F.lit("page "), n, F.lit(" "), "p", F.lit("join-\ned"), F.repeat(F.lit("x"), F.col("page")), F.lit("\nend "), n, F.lit("\n(c) footer"))
    return chunking.without_running_lines(pages.select("doc_id", "page", text.alias("text")))


@query("SELECT text AS question, role AS answer FROM conversations UNION ALL SELECT 'q ' || text, CAST(item_id AS VARCHAR) FROM benchmark")
def s11_qa_pairs(s, d):
    a = read(s, d, "conversations").select(F.col("text").alias("question"), F.col("role").alias("answer"))
    b = _items(s, d).select(F.concat(F.lit("q "), "text").alias("input"), F.col("item_id").cast("string").alias("output"))
    return io.read_qa(a).unionByName(io.read_qa(b))


@query("SELECT 'rows' AS file, count(*) AS n FROM nation UNION ALL SELECT 'report', 2 UNION ALL SELECT 'kept', count(*) FROM nation WHERE n_regionkey = 1")
def s12_jsonl_sink(s, d):
    """Rows overwrite what was there; a report of what was dropped stands beside them."""
    path, n = scratch.new_path(s, "sink"), read(s, d, "nation")
    io.write_jsonl(n.limit(3), path)
    marked = gates.first_reason(n, [("other region", F.col("n_regionkey") != 1)])
    io.write_jsonl(n, path, gates.report(marked))
    report = s.read.json(f"{path}.report")
    out = s.read.json(path).agg(F.lit("rows").alias("file"), F.count("*").alias("n")).unionByName(report.agg(F.lit("report").alias("file"), F.count("*").alias("n")))
    return out.unionByName(report.where("reason = 'kept'").select(F.lit("kept").alias("file"), "n"))


@query("""WITH t AS (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents),
c AS (SELECT source, doc_id, n, b, unnest(range(CAST(b // 1000 AS BIGINT), CAST((b + n - 1) // 1000 + 1 AS BIGINT))) AS block FROM t WHERE n > 0), z AS (SELECT source, sum(n) AS total FROM t GROUP BY 1)
SELECT source, block, CAST(sum(least(b + n, (block + 1) * 1000) - greatest(b, block * 1000)) AS BIGINT) AS tokens, md5(string_agg(CAST(doc_id AS VARCHAR) || ':' || CAST(least(b + n, (block + 1) * 1000) - greatest(b, block * 1000) AS VARCHAR), ',' ORDER BY doc_id)) AS digest
FROM c JOIN z USING (source) WHERE (block + 1) * 1000 <= total GROUP BY ALL""")
def s15_token_blocks(s, d):
    """Characters stand for tokens: a source's texts end to end, cut in blocks of 1,000, whole blocks only; written and read back."""
    path = scratch.new_path(s, "blocks")
    chars = _docs(s, d).select("source", "doc_id", F.expr("transform(sequence(1, greatest(length(text), 1)), i -> CAST(doc_id AS INT))").alias("tokens"), F.length("text").alias("n")).where("n > 0").drop("n")
    io.write_token_blocks(chars, path, "source", "doc_id", "tokens", 1000)
    got = s.read.parquet(path).select("source", "block", F.explode("tokens").alias("doc_id")).groupBy("source", "block", "doc_id").agg(F.count("*").alias("n"))
    g = got.groupBy("source", "block").agg(F.sum("n").alias("tokens"), F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("x"))
    return g.select("source", "block", "tokens", F.md5(F.array_join(F.transform("x", lambda y: F.concat(y["doc_id"].cast("string"), F.lit(":"), y["n"].cast("string"))), ",")).alias("digest"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1")
def s16_modulo_shard(s, d):
    return io.shard(_docs(s, d).select("doc_id"), "doc_id", 4, 1)


@query("""WITH g AS (SELECT (doc_id // 100) AS shard, min(doc_id) AS "offset", count(*) AS total FROM documents GROUP BY 1), t AS (SELECT *, coalesce(sum(total) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM g)
SELECT shard, "offset" + CAST(shard = 1 AS INTEGER) AS "offset", CAST(expected AS BIGINT) AS expected, "offset" + CAST(shard = 1 AS INTEGER) = expected AS tiles FROM t""")
def s17_shard_tiling(s, d):
    """Shards by offset; the second one's offset is one too large."""
    g = _docs(s, d).groupBy(F.floor(F.col("doc_id") / 100).alias("shard")).agg(F.min("doc_id").alias("offset"), F.count("*").alias("total"))
    g = g.withColumn("offset", F.col("offset") + (F.col("shard") == 1).cast("int"))
    return io.tiling(g).select("shard", "offset", "expected", "tiles")


@query("SELECT 2::BIGINT AS overlapping, 3::BIGINT AS missing, 1::BIGINT AS \"unknown\"")
def s18_shard_merge_checks(s, d):
    """Two ids stand in both shards, three in none, and one is unknown."""
    ids = _docs(s, d).select("doc_id")
    first = ids.where("doc_id < 50 AND doc_id NOT IN (7, 8, 9)").unionByName(s.range(1).select(F.lit(-5).cast("long").alias("doc_id")))
    return joins.partition_check([first, ids.where("doc_id >= 48")], ids, "doc_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, n_nationkey <> 3 AND n_nationkey <> 24 AS ok FROM nation")
def s19_checksums(s, d):
    """One file was changed, and one is missing."""
    path = scratch.new_path(s, "blobs")
    n = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value"))
    n.where("name <> '24'").withColumn("value", F.when(F.col("name") == "3", "changed").otherwise(F.col("value"))).repartition(F.col("name")).write.partitionBy("name").text(path)
    manifest = n.select("name", F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256"))
    return io.checksums(s, path, manifest, F.regexp_extract("path", "name=(.+)/", 1))


def _model(prompts):
    """A model that can't read some prompts, whatever the batch."""
    if any("ECONOMY" in p for p in prompts):
        raise ValueError("no ECONOMY")
    return [f"ANSWER: {'ABCD'[len(p) % 4]}" for p in prompts]


@query(f"WITH {MCQ}, {sql_run('base')} SELECT sample_id, CASE WHEN subject = 'ECONOMY' THEN NULL ELSE chr(CAST(65 + length(sample_id || ' ' || subject) % 4 AS INTEGER)) END AS letter, CASE WHEN subject = 'ECONOMY' THEN 'no ECONOMY' END AS error FROM base")
def s20_scorer(s, d):
    """A prompt that fails keeps its error, to be asked again; batches of one, so none takes others with it."""
    q = mcq(s, d).select("sample_id", F.concat("sample_id", F.lit(" "), "subject").alias("prompt"))
    got = scorers.score(q, _model, batch=1, retries=2)
    return got.select("sample_id", F.when(F.col("error").isNull(), T.parse_letter(F.col("completion"), F.lit(4))).alias("letter"), "error")


@query("SELECT doc_id, source AS src FROM documents WHERE NOT (starts_with(source, 'src1') OR starts_with(source, 'src2')) UNION ALL SELECT item_id, 'extra' FROM benchmark")
def s22_store_rewrite(s, d):
    store = _docs(s, d).select("doc_id", F.col("source").alias("src"))
    return io.without_sources(store, ["src1", "src2"], _items(s, d).select(F.col("item_id").alias("doc_id"), F.lit("extra").alias("src")))


@query("SELECT 'all' AS split, 1.0::DOUBLE AS covered")
def s23_answer_key(s, d):
    """Of splits that cover a few, most and all of the results' ids the last one is the key."""
    q = mcq(s, d).select("sample_id")
    splits = q.limit(20).withColumn("split", F.lit("dev")).unionByName(q.where("sample_id < 'q-000100'").withColumn("split", F.lit("part"))).unionByName(q.withColumn("split", F.lit("all")))
    return io.answer_key(q, splits)
