"""Tables of questions, runs and rollouts made from the driver's tables by keyed draws, in Spark and as DuckDB CTEs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ARMS = {"base": 0.70, "armx": 0.74, "army": 0.66}
ROLLOUTS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, choices, answer (0-based), subject."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("q-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("sample_id"),
        F.array("p_brand", "p_type", "p_name", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("choices"),
        (T.sha_byte(F.concat(F.lit("gold|"), F.col("p_partkey").cast("string"))) % 4).alias("answer"),
        F.col("p_type").alias("subject"),
    )


def run(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    """mcq with predicted, parse_failed, letter ('' if parsing failed) and correct."""
    q = mcq(spark, sf_dir)
    hit = T.h01(arm, F.col("sample_id")) < ARMS[arm]
    wrong = (F.col("answer") + 1 + T.sha_byte(F.concat(F.lit(f"{arm}w|"), "sample_id")) % 3) % 4
    q = q.withColumn("predicted", F.when(hit, F.col("answer")).otherwise(wrong)).withColumn("parse_failed", T.h01(f"u{arm}", F.col("sample_id")) < 0.01)
    return q.withColumn("letter", F.when(F.col("parse_failed"), "").otherwise(T.letter(F.col("predicted")))).withColumn("correct", ~F.col("parse_failed") & (F.col("predicted") == F.col("answer")))


#: Renderings of an answer (@ stands for its letter), and what the lenient, the official and the recovery parser read in them.
RENDERINGS = [
    ("ANSWER: @", "@", "@", "@"),
    ("ANSWER: A\nsome reasoning\nANSWER: @", "@", "@", "A"),
    ("so the ANSWER: @.", "@", "@", "@"),
    ("@) because", "@", "", "@"),
    ("", "", "", ""),
    ("@ because", "@", "", ""),
    ("@, since", "@", "", ""),
    ("ANSWER: @)", "@", "@", "@"),
    ("ANSWER:\n@", "@", "@", "@"),
    ("**ANSWER: @**", "@", "@", "@"),
    ("ANSWER: @ (foo)", "@", "@", "@"),
    ("ANSWER: @ - yes", "@", "@", "@"),
    ("see\nA) foo\nB) bar", "", "", "A"),
    ("The correct answer is **(@)** here", "", "", "@"),
    ("I think the answer is @.", "", "", "@"),
    ("Option @, as said, is the correct one", "", "", "@"),
    ("ANSWER: E", "", "", "E"),
    ("answer: @, or not", "", "", ""),
    ("ANSWER\u00a0:\u2003@", "@", "@", ""),
    (None, "", "", ""),
    ("@", "@", "", ""),
    ("  @: as the text says", "@", "", ""),
]


def completions(spark: SparkSession, sf_dir: str, arm: str = "base") -> DataFrame:
    """run with its answer rendered in one of many ways."""
    r = run(spark, sf_dir, arm)
    said = F.array(*[F.lit(text) for text, *_ in RENDERINGS])[T.sha_byte(F.concat(F.lit("c|"), "sample_id")) % len(RENDERINGS)]
    return r.withColumn("completion", F.replace(said, F.lit("@"), T.letter(F.col("predicted"))))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, subject, answer, k, predicted: ROLLOUTS rows a question."""
    q = mcq(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(ROLLOUTS - 1))).alias("k"))
    u = T.h01(F.concat(F.lit("k"), F.col("k").cast("string")), F.col("sample_id"))
    q = q.withColumn("u", u)
    return q.select("sample_id", "subject", "answer", "k", F.when(F.col("u") < 0.6, F.col("answer")).otherwise((F.col("answer") + 1 + F.floor(F.col("u") * 1000).cast("int") % 3) % 4).alias("predicted"))


# The same as text for DuckDB.
def sql_h(salt: str, key: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256({salt} || '|' || {key}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


def sql_byte(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 2) AS INTEGER)"


MCQ = f"""mcq AS (SELECT 'q-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS sample_id, [p_brand, p_type, p_name, 'size ' || CAST(p_size AS VARCHAR)] AS choices,
    {sql_byte("'gold|' || CAST(p_partkey AS VARCHAR)")} % 4 AS answer, p_type AS subject FROM part)"""


def sql_run(arm: str) -> str:
    return f"""{arm}0 AS (SELECT *, CASE WHEN {sql_h(f"'{arm}'", "sample_id")} < {ARMS[arm]} THEN answer ELSE (answer + 1 + {sql_byte(f"'{arm}w|' || sample_id")} % 3) % 4 END AS predicted,
    {sql_h(f"'u{arm}'", "sample_id")} < 0.01 AS parse_failed FROM mcq),
{arm} AS (SELECT *, CASE WHEN parse_failed THEN '' ELSE chr(65 + predicted) END AS letter, NOT parse_failed AND predicted = answer AS correct FROM {arm}0)"""


ROLL = f"""roll0 AS (SELECT *, unnest(range({ROLLOUTS})) AS k FROM mcq),
roll1 AS (SELECT *, {sql_h("'k' || CAST(k AS VARCHAR)", "sample_id")} AS u FROM roll0),
roll AS (SELECT sample_id, subject, answer, CAST(k AS INTEGER) AS k, CASE WHEN u < 0.6 THEN answer ELSE (answer + 1 + CAST(floor(u * 1000) AS INTEGER) % 3) % 4 END AS predicted FROM roll1)"""


def _sql_text(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    parts = re.split("([^ -~])", text.replace("'", "''"))
    return " || ".join(f"chr({ord(x)})" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x or not i)


_WAYS = ", ".join("(" + ", ".join([str(i), *map(_sql_text, row)]) + ")" for i, row in enumerate(RENDERINGS))
#: comp: runs of base with completion and what each parser reads in it.
SAID = f"""{MCQ}, {sql_run("base")}, ways(way, said, len, off, rec) AS (VALUES {_WAYS}),
comp AS (SELECT base.*, replace(said, '@', chr(65 + predicted)) AS completion, replace(len, '@', chr(65 + predicted)) AS lenient, replace(off, '@', chr(65 + predicted)) AS official,
    replace(rec, '@', chr(65 + predicted)) AS recovered FROM base JOIN ways ON way = {sql_byte("'c|' || sample_id")} % {len(RENDERINGS)})"""


# Items that a model might have made from documents, one a document: most are sound, each other way has one fault.
ITEM_WAYS = 20
_LOUD = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _loud(c):
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, text: documents with a line of a table of contents at their end."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("text", F.lit(" Scope ....... 12")).alias("text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, chunk_id, question, evidence, answer, distractors, why_wrong, choices, gold, way."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", r"[ \t\n\r\f]+"), "").alias("w"))
    d = d.withColumn("way", T.sha_byte(F.concat(F.lit("i|"), F.col("doc_id").cast("string"))) % ITEM_WAYS)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    d = d.withColumns({"q": F.concat(F.lit("Which words follow "), part(1, 6), F.lit(" in Release 7?")), "e": part(11, 20), "a": part(13, 3), "x": F.array(part(41, 3), part(51, 3), part(61, 3))})
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("copied"))
    d = d.join(F.broadcast(bench), F.col("b") == F.col("doc_id") % 40, "left")
    way = lambda k, then, other: F.when(F.col("way") == k, then).otherwise(other)
    question = way(6, F.lit("Which Release is asked for twice by one and the same set?"), F.col("q"))
    question = way(11, F.concat(F.lit("Is it "), "a", F.lit(" in Release 7?")), question)
    question = way(12, F.concat(F.lit("Which change request introduced "), part(1, 4), F.lit(" in Release 7?")), question)
    question = way(15, F.concat("copied", F.lit(" Release")), way(16, F.concat(F.lit("According to the passage, what follows "), part(1, 6), F.lit("? Release")), question))
    question = way(17, F.lit(" "), way(18, F.concat(F.lit("What follows "), part(1, 6), F.lit("?")), question))
    evidence = way(4, F.concat(F.lit("invented "), "e"), way(7, F.lit(""), way(13, F.lit("Scope ....... 12"), F.col("e"))))
    answer = way(5, part(71, 3), way(10, F.col("e"), way(13, F.lit("Scope"), F.col("a"))))
    wrong = way(8, F.slice("x", 1, 2), way(9, F.array(F.col("x")[0], _loud("a"), F.col("x")[2]), way(14, F.array(F.col("x")[0], F.col("x")[1], _loud(F.col("x")[0])), F.col("x"))))
    out = d.select(F.col("doc_id").alias("item_id"), way(19, F.lit(-1).cast("long"), F.col("doc_id")).alias("chunk_id"), question.alias("question"), evidence.alias("evidence"), answer.alias("answer"), wrong.alias("distractors"), "way")
    out = out.withColumn("why_wrong", way(3, F.array(F.lit("no"), F.lit("no")), F.transform("distractors", lambda x: F.lit("no"))))
    out = out.withColumn("gold", F.pmod("item_id", F.size("distractors") + 1).cast("int"))
    return out.withColumn("choices", F.expr("concat(slice(distractors, 1, gold), array(answer), slice(distractors, gold + 1, 9))"))


def _sql_part(a: int, n: int) -> str:
    return f"array_to_string(w[{a}:{a + n - 1}], ' ')"


ITEMS = f"""chunks AS (SELECT doc_id AS chunk_id, text || ' Scope ....... 12' AS text FROM documents),
id0 AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), lambda x: x <> '') AS w, {sql_byte("'i|' || CAST(doc_id AS VARCHAR)")} % {ITEM_WAYS} AS way FROM documents),
id1 AS (SELECT id0.*, 'Which words follow ' || {_sql_part(1, 6)} || ' in Release 7?' AS q, {_sql_part(11, 20)} AS e, {_sql_part(13, 3)} AS a, [{_sql_part(41, 3)}, {_sql_part(51, 3)}, {_sql_part(61, 3)}] AS x, b.text AS copied FROM id0 LEFT JOIN benchmark b ON b.item_id = doc_id % 40),
id2 AS (SELECT doc_id AS item_id, CASE WHEN way = 19 THEN -1 ELSE doc_id END AS chunk_id, way,
  CASE way WHEN 6 THEN 'Which Release is asked for twice by one and the same set?' WHEN 11 THEN 'Is it ' || a || ' in Release 7?' WHEN 12 THEN 'Which change request introduced ' || {_sql_part(1, 4)} || ' in Release 7?'
    WHEN 15 THEN copied || ' Release' WHEN 16 THEN 'According to the passage, what follows ' || {_sql_part(1, 6)} || '? Release' WHEN 17 THEN ' ' WHEN 18 THEN 'What follows ' || {_sql_part(1, 6)} || '?' ELSE q END AS question,
  CASE way WHEN 4 THEN 'invented ' || e WHEN 7 THEN '' WHEN 13 THEN 'Scope ....... 12' ELSE e END AS evidence, CASE way WHEN 5 THEN {_sql_part(71, 3)} WHEN 10 THEN e WHEN 13 THEN 'Scope' ELSE a END AS answer,
  CASE way WHEN 8 THEN x[1:2] WHEN 9 THEN [x[1], translate(a, {_LOUD}), x[3]] WHEN 14 THEN [x[1], x[2], translate(x[1], {_LOUD})] ELSE x END AS distractors FROM id1),
id3 AS (SELECT *, CASE WHEN way = 3 THEN ['no', 'no'] ELSE list_transform(distractors, lambda x: 'no') END AS why_wrong, CAST(item_id % (len(distractors) + 1) AS INTEGER) AS gold FROM id2),
items AS (SELECT *, list_concat(list_concat(distractors[1:gold], [answer]), distractors[gold + 1:]) AS choices FROM id3)"""
