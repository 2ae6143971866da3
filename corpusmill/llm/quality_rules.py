"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` adds the counts that the rules look at; ``cascade`` times every rule and counts what it rejects on a
sample, then orders the rules by rejections per second and evaluates them as one CASE, which stops at the first rule
that rejects. The order changes the cost only: a document is kept if no rule rejects it.

Defined cases: a null or empty text has no words and every count 0; repeated rows each get their own row; columns of
the input that the operator also makes (n_words and so on) are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, WORD, let, table

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and rejections are measured.
SAMPLE_ROWS = 1000

#: Name and SQL of each rule over the columns of measure(); true rejects. A null never rejects.
RULES = {
    "mean_word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "symbol_share": "n_symbols * 10 > n_words",
    "repeated_lines": "n_dup_lines * 2 > n_lines",
    "few_letters": r"size(filter(words, w -> w rlike '\\p{L}')) * 10 < n_words * 7",
    "shouting": r"size(filter(words, w -> NOT w rlike '\\p{Ll}' AND w rlike '\\p{Lu}[^\\p{Lu}]*\\p{Lu}')) * 10 > n_words * 3",
    "exclamations": "(length(text) - length(replace(text, '!!', ''))) * 5 > n_words",
    "bullets": r"n_lines > 0 AND size(filter(lines, l -> l rlike '^[\\x20\\x09]*[-*•]')) * 10 > n_lines * 9",
    "ellipses": r"n_lines > 0 AND size(filter(lines, l -> l rlike '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$')) * 10 > n_lines * 3",
}


#: Words covered by windows of three words that the text has twice: windows as (digest, place) by digest, then the places
#: that share a digest; each covers three words, or as many as there are up to the next such place.
_REPEATED = "CASE WHEN size(words) < 3 THEN 0L ELSE " + let(
    "words",
    "ws",
    let(
        "sort_array(transform(sequence(0, size(ws) - 3), i -> struct(xxhash64(ws[i], ws[i + 1], ws[i + 2]) AS h, i AS p)))",
        "s",
        let(
            "sort_array(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.p))",
            "q",
            "aggregate(transform(q, (p, i) -> least(3, coalesce(get(q, i + 1) - p, 3))), 0L, (a, x) -> a + x)",
        ),
    ),
) + " END"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), words, lines (those with a word) and the counts."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    d = d.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
    )
    d = d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return d


def cascade_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections per second of cost first; both come from a sample of sample_rows rows."""
    sample = measure(docs.where("pmod(xxhash64(doc_id), 16) = 0").limit(sample_rows)).where("NOT base_failed").persist()
    try:
        rows = sample.count()

        def timed(sql: str) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = sample.agg(F.coalesce(F.sum(F.expr(sql).cast("int")), F.lit(0))).first()[0]
            return time.perf_counter() - began, rejected

        if not rows:
            return list(rules)
        timed("n_words < 0")
        floor = timed("n_words < 0")[0]
        gain = {}
        for name, sql in rules.items():
            seconds, rejected = timed(sql)
            gain[name] = rejected / rows / max(seconds - floor, 1e-4)
        return sorted(rules, key=lambda name: -gain[name])
    finally:
        sample.unpersist()


def cascade(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """True where no rule rejects; a CASE evaluates its branches in order and stops at the first that holds."""
    out = F.when(F.col("base_failed"), False)
    for name in order:
        out = out.when(F.expr(rules[name]), False)
    return out.otherwise(True)


def quality(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    return measure(docs).withColumn("kept", cascade(cascade_order(docs, rules), rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
g AS (SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r) GROUP BY 1),
m AS (SELECT d.doc_id, d.text, words, lines, len(words) AS n_words, len(lines) AS n_lines, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
            OR len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) * 10 < n_words * 7
            OR len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{Ll}') AND regexp_matches(w, '\p{Lu}[^\p{Lu}]*\p{Lu}'))) * 10 > n_words * 3
            OR (length(text) - length(replace(text, '!!', ''))) * 5 > n_words
            OR (n_lines > 0 AND len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09]*[-*•]'))) * 10 > n_lines * 9)
            OR (n_lines > 0 AND len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09\x0D]*$'))) * 10 > n_lines * 3)) AS kept
FROM b
"""
