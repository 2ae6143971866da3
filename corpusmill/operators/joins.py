"""Joins with checks: hit-rate guards, merges with origin, upserts, partition checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import ranges
from .contamination import small
from .gates import guard


def full_merge(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """on, value (b's where there), origin: a, b or both."""
    j = a.select(on, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(on, F.col(value).alias("_b"), F.lit(1).alias("_ib")), on, "full")
    return j.select(on, F.coalesce("_b", "_a").alias(value), F.when(F.col("_ib").isNull(), "a").when(F.col("_ia").isNull(), "b").otherwise("both").alias("origin"))


def upsert(parent: DataFrame, retry: DataFrame, on: str) -> DataFrame:
    """parent's rows, replaced by retry's where it has one; retry's other ids are ignored."""
    r = retry.select(F.col(on).alias("_on"), F.struct(*[F.col(c) for c in parent.columns if c != on]).alias("_new"))
    j = parent.join(r, F.col(on) == F.col("_on"), "left")
    return j.select(*[F.col(c) if c == on else F.when(F.col("_on").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in parent.columns])


def hit_rate(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """n, matched, rate of left rows that right has."""
    j = left.select(on).join(right.select(on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    return j.agg(F.count("*").alias("n"), F.count("_hit").alias("matched")).withColumn("rate", F.round(F.col("matched") / F.col("n"), 6))


def partition_check(parts: list[DataFrame], whole: DataFrame, on: str) -> DataFrame:
    """overlapping, missing, unknown ids when parts should make up the whole; all 0 if they do."""
    u = parts[0].select(on)
    for p in parts[1:]:
        u = u.unionByName(p.select(on))
    counts = u.groupBy(on).agg(F.count("*").alias("n"))
    j = counts.join(whole.select(on).distinct().withColumn("_in", F.lit(1)), on, "full")
    return j.agg(F.count_if(F.col("n") > 1).alias("overlapping"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_in").isNull()).alias("unknown"))


def resume(todo: DataFrame, done: DataFrame, on: str, error: str = "error") -> DataFrame:
    """Rows of todo that are not done yet; failed ones are tried again."""
    return todo.join(done.where(F.col(error).isNull()).select(on).distinct(), on, "left_anti")


def by_question(pairs: DataFrame, tests: DataFrame, pair_id: str, test_id: str) -> DataFrame:
    """pair_id, test_id, kind (exact, without_tag) of pairs whose question is a test's, as it stands or but for its [tags]; both have question. exact goes before, ties to the least test_id."""
    key = T.norm_ws_lower(F.col("question"))
    bare = T.norm_ws_lower(F.regexp_replace("question", r"\[[^\]]+\]", ""))
    keys = tests.select(test_id, F.explode(F.array(F.struct(key.alias("key"), F.lit(0).alias("way")), F.struct(bare.alias("key"), F.lit(1).alias("way")))).alias("k")).select(test_id, "k.*")
    met = pairs.select(pair_id, key.alias("key")).join(keys, "key").groupBy(pair_id).agg(F.min(F.struct("way", test_id)).alias("m"))
    return met.select(pair_id, F.col(f"m.{test_id}").alias(test_id), F.when(F.col("m.way") == 0, "exact").otherwise("without_tag").alias("kind"))


def misaligned(a: DataFrame, b: DataFrame, place: str, text: str) -> DataFrame:
    """place of rows whose texts differ, or that one side lacks."""
    j = a.select(place, F.trim(text).alias("_a")).join(b.select(place, F.trim(text).alias("_b")), place, "full")
    return j.where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).select(place)


def aligned(a: DataFrame, b: DataFrame, place: str, text: str) -> DataFrame:
    """a with b's columns (but place and text) of the same place; reading it fails if any two texts differ."""
    bad = misaligned(a, b, place, text).agg(F.count("*").alias("_bad"))
    j = a.join(b.drop(text), place).crossJoin(F.broadcast(bad))
    return guard(j, F.col("_bad") > 0, "rows are misaligned").drop("_bad")


def neighbours(edges: DataFrame, unit: str, key: str, salt: str, n: int = 3) -> DataFrame:
    """unit, other: for each unit up to n others that share a key with it, drawn by hash. Of a key's units each meets those that follow it in the key's hash order, so a key of very many isn't squared."""
    own = edges.select(unit, key).distinct()
    own = ranges.numbered(own, [key], [T.hash_order(salt, F.col(unit)), F.col(unit)], "_i").join(own.groupBy(key).agg(F.count("*").alias("_n")), key)
    steps = own.withColumn("_j", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("_n") - 1)))).where("_n > 1").withColumn("_j", F.pmod(F.col("_i") + F.col("_j"), "_n"))
    met = steps.select(unit, key, "_j").join(own.select(key, F.col("_i").alias("_j"), F.col(unit).alias("other")), [key, "_j"]).select(unit, "other").distinct()
    rank = F.row_number().over(W.partitionBy(unit).orderBy(T.hash_order(salt, F.concat_ws("|", unit, "other")), "other"))
    return met.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def containing(docs: DataFrame, strings: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, string_id: documents that hold a string of k words or more; an equi-join on its first k words goes before the test. Both normalised alike: doc_id, text; string_id, string."""
    words = lambda c: F.array_remove(F.split(c, " "), "")
    own = strings.select("string_id", "string", words(F.col("string")).alias("w")).where(F.size("w") >= k).select("string_id", "string", F.array_join(F.slice("w", 1, k), " ").alias("begin"))
    probes = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(T.shingles("w", k))).alias("begin"))
    hits = probes.join(own, "begin").select("doc_id", "string_id", "string").join(docs.select("doc_id", "text"), "doc_id")
    return hits.where(F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), "string", F.lit(" ")))).select("doc_id", "string_id")


def located(windows: DataFrame, docs: DataFrame, k: int = 12) -> DataFrame:
    """win_id, found: a window's first k words, or those around its middle, stand in a document; shorter windows aren't looked for. Runs of k words meet the windows' keys before anything is shuffled, unless there are too many keys for a broadcast."""
    w = windows.select("win_id", T.words(T.norm_ws_lower(F.col("text"))).alias("w")).where(F.size("w") >= k)
    middle = F.greatest(F.lit(0), F.floor(F.size("w") / 2) - k // 2)
    keys = w.select("win_id", F.explode(F.array(F.array_join(F.slice("w", 1, k), " "), F.array_join(F.slice("w", (middle + 1).cast("int"), F.lit(k)), " "))).alias("key"))
    runs = docs.select(T.words(T.norm_ws_lower(F.col("text"))).alias("w")).select(F.explode(T.shingles("w", k)).alias("key"))
    hits = runs.join(small(keys), "key").select("win_id").distinct().withColumn("found", F.lit(True))
    return w.select("win_id").join(hits, "win_id", "left").select("win_id", F.coalesce("found", F.lit(False)).alias("found"))


def missing_from(part: DataFrame, whole: DataFrame, on: str) -> DataFrame:
    """Rows of part whose id whole lacks; none if part is a subset."""
    return part.select(on).distinct().join(whole.select(on), on, "left_anti")


def split_key(rows: DataFrame, key: str, first: str, second: str, mark: str = "|") -> DataFrame:
    """rows with the two parts of a composite key."""
    part = lambda i: F.split_part(F.col(key), F.lit(mark), F.lit(i))
    return rows.withColumn(first, part(1)).withColumn(second, part(2))
