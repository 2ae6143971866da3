"""Retrieval: BM25, window scores, idf cosine, dense re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .contamination import item_terms, small

K1, B = 1.5, 0.75


def top(scores: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each key with rank; Spark limits each group before it shuffles."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, max_df: float = 0.25, by: str | None = None) -> DataFrame:
    """item_id, doc_id, score, rank. Only terms that a query has are counted; terms in more than max_df of the documents are dropped; lengths count all terms.

    by: a column of docs, and item_id of queries, that gives each query an index of its own documents. The corpus is read once: each document
    carries a row without a term for its length, and counts by document are shuffled once and used for both df and scores.
    """
    own = [by] if by else []
    terms = item_terms(queries)
    vocabulary = terms.select("term").distinct()
    known = small(vocabulary.withColumn("known", F.lit(True)))
    tokens = docs.select("doc_id", *own, T.all_terms(F.col("text")).alias("t"))
    each = tokens.select("doc_id", *own, F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(""))).alias("term")).join(known, "term", "left").where("known OR term = ''")
    tf = each.groupBy("doc_id", *own, "dl", "term").agg(F.count("*").alias("tf"))
    facts = tf.where("term = ''").groupBy(*own).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    counts = tf.where("term <> ''").groupBy(*own, "term").agg(F.count("*").alias("df"))
    df = (counts.join(facts, own) if by else counts.crossJoin(F.broadcast(facts))).where(F.col("df") <= max_df * F.col("n"))
    idf = df.select(*own, "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = tf.where("term <> ''").join(idf, [*own, "term"]).select("doc_id", *own, "term", part.alias("part"))
    if by:
        met = weighted.withColumnRenamed(by, "item_id").join(terms, ["item_id", "term"])
    else:
        met = weighted.join(small(terms), "term")
    scores = met.groupBy("item_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scores, "item_id", "score", "doc_id", k)


def distinct_starts(ranked: DataFrame, key: str, text: str, chars: int, k: int) -> DataFrame:
    """Of each key's rows by rank the first k whose texts begin differently, ranked anew."""
    first = F.row_number().over(W.partitionBy(key, F.substring(text, 1, chars)).orderBy("rank"))
    kept = ranked.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("rank"))).where(F.col("rank") <= k)


def rescored_windows(windows: DataFrame, found: DataFrame, queries: DataFrame, k: int, chars: int = 120) -> DataFrame:
    """item_id, win_id, score, rank: windows of the documents found for an item, by the idf (over windows) of the item's terms they have; of those that begin alike the best stays."""
    terms = item_terms(queries)
    some = windows.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    have = some.select("doc_id", "win_id", "text", F.explode(T.content_terms(F.col("text"))).alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    n = some.agg(F.count("*").alias("n"))
    idf = have.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    pairs = have.join(idf, "term").join(small(terms), "term").join(found.select("item_id", "doc_id"), ["item_id", "doc_id"])
    scores = pairs.groupBy("item_id", "win_id").agg(F.round(F.sum("idf"), 6).alias("score"), F.first(F.substring("text", 1, chars)).alias("begin"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "win_id")))
    return distinct_starts(ranked, "item_id", "begin", chars, k).select("item_id", "win_id", "score", "rank")


def answer_in_context(context: DataFrame, gold: DataFrame, share: float = 0.8) -> DataFrame:
    """item_id, found: share of the gold's terms that the context has is enough; false if the gold has no terms. context: item_id, text; gold: item_id, text."""
    c = context.select("item_id", T.content_terms(F.col("text")).alias("c"))
    g = gold.select("item_id", T.content_terms(F.col("text")).alias("g"))
    return g.join(c, "item_id", "left").select("item_id", F.coalesce((F.size("g") > 0) & (F.size(F.array_intersect("g", "c")) >= share * F.size("g")), F.lit(False)).alias("found"))


def idf_cosine(docs: DataFrame, queries: DataFrame, k: int = 3, max_df: float = 0.2) -> DataFrame:
    """Cosine of term sets with squared idf, terms in fewer than max_df of the documents. Terms of the corpus are its whole vocabulary, so they are joined by a shuffle."""
    own = docs.select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    idf = own.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") < max_df * F.col("n")).select("term", F.pow(F.log(F.col("n") / F.col("df")), 2).alias("w"))
    q = item_terms(queries).join(idf, "term")
    qn = q.groupBy("item_id").agg(F.sqrt(F.sum("w")).alias("qn"))
    asked = q.groupBy("term").agg(F.collect_list("item_id").alias("items"))
    d = own.join(idf, "term").join(asked, "term", "left")
    # One pass by document: its norm, and what it shares with each item.
    per = d.select("doc_id", "w", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("items", F.array().cast("array<long>")))).alias("item_id"))
    sums = per.groupBy("doc_id", "item_id").agg(F.sum("w").alias("s"))
    norm = sums.where("item_id IS NULL").select("doc_id", F.sqrt("s").alias("dn"))
    scores = sums.where("item_id IS NOT NULL").join(norm, "doc_id").join(qn, "item_id").select("item_id", "doc_id", F.round(F.col("s") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    return top(scores.where("score > 0"), "item_id", "score", "doc_id", k)


def dense_rerank(pool: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, score (cosine), rank over pool rows that share the query's label; vectors of norm 0 take no part."""
    norm = lambda d: d.withColumn("n", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).where("n > 0")
    q = norm(queries).select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("qe"), F.col("n").alias("qn"))
    dot = F.aggregate(F.zip_with("qe", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    s = norm(pool).join(small(q), "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(dot / (F.col("qn") * F.col("n")), 6).alias("score"))
    return top(s, "query_id", "score", "vec_id", k)


def best_of_forms(docs: DataFrame, forms: list[DataFrame], k: int = 20) -> DataFrame:
    """bm25 for each form of the queries; a document's score is its best one, ranked anew."""
    found = [bm25(docs, q, k).select("item_id", "doc_id", "score") for q in forms]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return top(every.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), "item_id", "score", "doc_id", k)


def passage_scores(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score, rank over each query's own passages (item_id, doc_id, text): idf of shared words, divided by the root of the passage's words."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9.\-_]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(*T.RETRIEVAL_STOP)))
    own = passages.select("item_id", "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    pool = own.groupBy("item_id").agg(F.count("*").alias("pool"))
    each = own.select("item_id", "doc_id", "n_words", F.explode("w").alias("word"))
    asked = queries.select("item_id", F.explode(words(F.col("text"))).alias("word"))
    met = each.join(small(asked), ["item_id", "word"])
    df = met.groupBy("item_id", "word").agg(F.count("*").alias("df")).join(pool, "item_id").select("item_id", "word", F.log(1 + F.col("pool") / (1 + F.col("df"))).alias("idf"))
    scores = met.join(df, ["item_id", "word"]).groupBy("item_id", "doc_id", "n_words").agg(F.sum("idf").alias("s"))
    return top(scores.select("item_id", "doc_id", F.round(F.col("s") / F.sqrt(F.col("n_words") + 1), 6).alias("score")), "item_id", "score", "doc_id", k)


def tightest_spans(pairs: DataFrame, least: int = 3) -> DataFrame:
    """item_id, doc_id, span, n_options: of the documents that hold least of an item's options the one where they stand closest. pairs: item_id, doc_id, text, options (both normalised); ties to the smaller doc_id."""
    at = F.filter(F.transform("options", lambda o: F.struct(F.instr(F.col("text"), o).alias("a"), F.length(o).alias("n"))), lambda x: (x["a"] > 0) & (x["n"] > 0))
    held = pairs.select("item_id", "doc_id", at.alias("s")).where(F.size("s") >= least)
    span = F.array_max(F.transform("s", lambda x: x["a"] + x["n"])) - F.array_min(F.transform("s", lambda x: x["a"]))
    best = held.select("item_id", "doc_id", span.alias("span"), F.size("s").alias("n_options")).groupBy("item_id").agg(F.min(F.struct("span", "doc_id", "n_options")).alias("b"))
    return best.select("item_id", "b.doc_id", "b.span", "b.n_options")
