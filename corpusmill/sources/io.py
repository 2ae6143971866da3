"""Readers and writers: JSON lines, envelopes, text folders, shards, resumable appends, token blocks, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Strict: a bad line fails the read. Else bad lines stay with their text in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_results(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Rows of a JSON document that is a list, an object of rows, or an envelope with results."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(row))
    inner = F.from_json(F.get_json_object("value", "$.results"), T.ArrayType(row))
    keyed = F.map_values(F.from_json("value", T.MapType(T.StringType(), row)))
    kind = F.when(F.trim("value").startswith("["), listed).when(F.get_json_object("value", "$.results").isNotNull(), inner).otherwise(keyed)
    return raw.select(F.explode(kind).alias("r")).select("r.*")


def read_text_folder(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text of every file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_column(df: DataFrame, names: tuple[str, ...] = ("text", "content", "body")) -> str:
    return next(c for c in names if c in df.columns)


def read_qa(df: DataFrame) -> DataFrame:
    """question and answer, under either of two names."""
    pick = lambda *names: F.coalesce(*[F.col(c) for c in names if c in df.columns])
    return df.select(pick("question", "input").alias("question"), pick("answer", "output").alias("answer"))


def blob(*columns: str) -> Column:
    return F.concat_ws(" \n ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def write_jsonl(df: DataFrame, path: str, report: DataFrame | None = None) -> None:
    df.write.mode("overwrite").json(path)
    if report is not None:
        report.write.mode("overwrite").json(f"{path}.report")


def append_missing(todo: DataFrame, path: str, on: str, schema: T.StructType) -> DataFrame:
    """Rows of todo that path doesn't hold without an error; write what is made of them with mode append."""
    from pyspark.errors import AnalysisException

    from ..operators.joins import resume

    try:
        done = todo.sparkSession.read.schema(schema).json(path)
    except AnalysisException:  # nothing written yet
        return todo
    return resume(todo, done, on)


def shard(df: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """Every n-th row from the k-th on, by declared order."""
    from ..operators import ranges

    return ranges.numbered(df, [], [F.col(order)], "_i").where(F.pmod("_i", F.lit(n)) == k).drop("_i")


def tiling(shards: DataFrame) -> DataFrame:
    """shards: offset, total. Adds expected, the sum of the totals before; tiles is whether they agree."""
    before = F.coalesce(F.sum("total").over(W.orderBy("offset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("expected", before).withColumn("tiles", F.col("offset") == F.col("expected"))


def without_sources(store: DataFrame, prefixes: list[str], extra: DataFrame | None = None) -> DataFrame:
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col("src").startswith(p)
    kept = store.where(~bad)
    return kept.unionByName(extra) if extra is not None else kept


def checksums(spark: SparkSession, path: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """name, ok: files against a manifest of name and sha256; name: of the column path, the file's name if not given."""
    found = F.element_at(F.split("path", "/"), -1) if name is None else name
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(path).select(found.alias("name"), F.sha2("content", 256).alias("have"))
    return manifest.join(files, "name", "left").select("name", F.coalesce(F.col("have") == F.col("sha256"), F.lit(False)).alias("ok"))


def answer_key(results: DataFrame, splits: DataFrame, share: float = 0.99) -> DataFrame:
    """split, covered: the split whose ids cover most of the results' ids, if at least the share."""
    n = results.select("sample_id").distinct().agg(F.count("*").alias("n"))
    hits = splits.select("split", "sample_id").distinct().join(results.select("sample_id").distinct(), "sample_id").groupBy("split").agg(F.count("*").alias("hits"))
    return hits.crossJoin(F.broadcast(n)).select("split", F.round(F.col("hits") / F.col("n"), 6).alias("covered")).where(F.col("covered") >= share).orderBy(F.desc("covered"), "split").limit(1)


def write_token_blocks(rows: DataFrame, path: str, key: str, order: str, tokens: str, size: int) -> None:
    """Writes key, block, tokens: each key's tokens end to end in order, cut in blocks of size; a last one that isn't full goes.

    A row's part of a block is found from the running sum of lengths, so no task holds more than the rows of its blocks.
    """
    from ..operators import ranges

    laid = ranges.running(rows.withColumn("_n", F.size(tokens)), [key], [F.col(order)], F.col("_n"), "_b").where("_n > 0")
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("_b") / size), F.floor((F.col("_b") + F.col("_n") - 1) / size))))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("_b"))
    last = F.least(F.col("_n").cast("long"), (F.col("block") + 1) * size - F.col("_b"))
    part = cut.select(key, "block", F.struct(F.col("_b"), F.slice(tokens, (first + 1).cast("int"), (last - first).cast("int")).alias("t")).alias("p"))
    whole = part.groupBy(key, "block").agg(F.array_sort(F.collect_list("p")).alias("p")).select(key, "block", F.flatten(F.transform("p", lambda x: x["t"])).alias("tokens"))
    whole.where(F.size("tokens") == size).write.parquet(path)
