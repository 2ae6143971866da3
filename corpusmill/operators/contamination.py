"""Contamination and coverage: shingle scans, staged verification, rare-term coverage, containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows and bytes of a side that may be broadcast; above, both sides are shuffled by the key.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a table of items or queries, with a broadcast hint if it is small; the look at it stops at the bound.

    What hangs on the corpus is never asked: that would read it once more at plan time.
    """
    size = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns])) + 16 * len(df.columns)
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def without_prefix(items: DataFrame, pattern: str) -> DataFrame:
    """items with every match of a boilerplate pattern taken out of their text; . matches line feeds."""
    return items.withColumn("text", F.regexp_replace("text", f"(?s){pattern}", ""))


def target_index(items: DataFrame, k: int) -> DataFrame:
    """shingle, item_id: the first item that has it."""
    words = items.select("item_id", T.scan_words(F.col("text")).alias("w"))
    return words.select("item_id", F.explode(T.shingles("w", k)).alias("shingle")).groupBy("shingle").agg(F.min("item_id").alias("item_id"))


def scan(docs: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, item_id: records that share a run of k words with an item, once each; [tags] don't count. Shingles are distinct by document before the join and reduced by it before the shuffle."""
    words = docs.select("doc_id", T.scan_words(F.col("text")).alias("w"))
    probes = words.select("doc_id", F.explode(F.array_distinct(T.shingles("w", k))).alias("shingle"))
    return probes.join(small(target_index(items, k)), "shingle").select("doc_id", "item_id").distinct()


def hits_by_item(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item_id").agg(F.count("*").alias("n_records"))


def scan_summary(edges: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """hit, total, frac and too_short (items of fewer than k words), one row."""
    n = items.select(F.size(T.scan_words(F.col("text"))).alias("n")).agg(F.count("*").alias("total"), F.count_if(F.col("n") < k).alias("too_short"))
    return edges.agg(F.countDistinct("item_id").alias("hit")).crossJoin(n).select("hit", "total", F.round(F.col("hit") / F.col("total"), 6).alias("frac"), "too_short")


def tail_tiers(docs: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """item_id, tail_hits, full_hits, gold_hits: records with an item's last k words, of those the ones with the whole item, and of those the ones with its gold, too.

    items: item_id, text, and gold, if there. The tail is an equi-join of (doc_id, shingle), so no theta join is left; texts are fetched for the hits alone.
    """
    gold = T.norm_tag_deleted(F.col("gold")) if "gold" in items.columns else F.lit("")
    own = items.select("item_id", T.scan_words(F.col("text")).alias("w"), gold.alias("gold")).where(F.size("w") >= k)
    tails = small(own.select("item_id", T.tail("w", k).alias("shingle")))
    probes = docs.select("doc_id", T.scan_words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(T.shingles("w", k))).alias("shingle"))
    hits = probes.join(tails, "shingle").select("doc_id", "item_id")
    texts = docs.select("doc_id", T.norm_tag_deleted(F.col("text")).alias("doc"))
    met = hits.join(texts, "doc_id").join(small(own.select("item_id", F.array_join("w", " ").alias("item"), "gold")), "item_id")
    full = F.col("doc").contains(F.col("item"))
    gold = full & (F.col("gold") != "") & F.col("doc").contains(F.col("gold"))
    return met.groupBy("item_id").agg(F.count("*").alias("tail_hits"), F.count_if(full).alias("full_hits"), F.count_if(gold).alias("gold_hits"))


def without_tails(rows: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """rows (doc_id, text) whose last k words are no item's last k words."""
    key = lambda d: T.tail("w", k)
    own = items.select(T.plain_words(F.col("text")).alias("w")).select(key(0).alias("_tail")).distinct()
    marked = rows.withColumn("w", T.plain_words(F.col("text"))).withColumn("_tail", key(0))
    return marked.join(small(own), "_tail", "left_anti").drop("w", "_tail")


def copy_check(docs: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """doc_id of rows that equal an item word by word or end in an item's last k words; [tags] don't count."""
    norm = lambda d: d.withColumn("w", T.scan_words(F.col("text"))).withColumn("_all", F.array_join("w", " ")).withColumn("_tail", T.tail("w", k))
    own = norm(items)
    keys = own.select(F.col("_all").alias("_key")).unionByName(own.where(F.size("w") >= k).select(F.col("_tail").alias("_key"))).distinct()
    probe = norm(docs).select("doc_id", F.explode(F.array_distinct(F.array("_all", "_tail"))).alias("_key"))
    return probe.join(small(keys), "_key", "left_semi").select("doc_id").distinct()


def item_terms(items: DataFrame, terms: Callable[[Column], Column] = T.content_terms) -> DataFrame:
    return items.select("item_id", F.explode(terms(F.col("text"))).alias("term"))


def rare_terms(items: DataFrame, max_df: int, terms: Callable[[Column], Column] = T.coverage_terms) -> DataFrame:
    """item_id, term: terms that at most max_df items have."""
    found = item_terms(items, terms)
    rare = found.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df).select("term")
    return found.join(rare, "term")


def _best(shared: DataFrame, terms: DataFrame, unit: str) -> DataFrame:
    """shared: item_id, unit, n (terms that they share). A row for each item: n_terms, coverage, best."""
    n = terms.groupBy("item_id").agg(F.count("*").alias("n_terms"))
    best = shared.groupBy("item_id").agg(F.max("n").alias("n"), F.max_by(unit, F.struct("n", -F.col(unit))).alias("best"))
    return n.join(best, "item_id", "left").select("item_id", "n_terms", F.round(F.coalesce("n", F.lit(0)) / F.col("n_terms"), 6).alias("coverage"), "best")


def best_coverage(units: DataFrame, unit: str, items: DataFrame, terms: Callable[[Column], Column] = T.coverage_terms) -> DataFrame:
    """item_id, n_terms, coverage (largest share of the item's terms in one unit, 0 if none), best (smallest unit that has it).

    units: unit, text; items: item_id, term. One join reduces the units' terms before anything is shuffled.
    """
    found = units.select(unit, F.explode(terms(F.col("text"))).alias("term"))
    return _best(found.join(small(items), "term").groupBy("item_id", unit).agg(F.count("*").alias("n")), items, unit)


def windows(docs: DataFrame, size: int = 40, stride: int = 20) -> DataFrame:
    """doc_id, start, win_id (doc_id * 1000000 + start), text: word windows of documents."""
    w = docs.select("doc_id", T.plain_words(F.col("text")).alias("w")).select("doc_id", F.explode(T.word_windows("w", size, stride)).alias("x"))
    return w.select("doc_id", F.col("x.start").alias("start"), (F.col("doc_id") * 1000000 + F.col("x.start")).alias("win_id"), F.array_join("x.words", " ").alias("text"))


def coverage_buckets(coverage: DataFrame) -> DataFrame:
    c = F.col("coverage")
    return coverage.agg(F.count("*").alias("items"), F.count_if(c == 1).alias("full"), F.count_if(c >= 0.8).alias("ge80"), F.count_if(c >= 0.5).alias("ge50"), F.count_if(c < 0.2).alias("lt20"), F.round(F.avg("coverage"), 6).alias("mean"))


def pooled_depth(per_unit: DataFrame, depths: list[int]) -> DataFrame:
    """depth, reached: items whose rank (first unit that answers) is at most the depth."""
    d = per_unit.sparkSession.createDataFrame([(x,) for x in depths], "depth int")
    return per_unit.select("rank").where("rank IS NOT NULL").crossJoin(F.broadcast(d)).groupBy("depth").agg(F.count_if(F.col("rank") <= F.col("depth")).alias("reached"))
