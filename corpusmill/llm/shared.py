"""Tables in the folder that the driver and all executors share, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Java and RE2 pattern of the white space that parts words, and of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temp folder, in local mode only: on a cluster it must be one that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_BYTES: what a task and its Python worker hold doesn't grow with the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: the row's number from 0 in the order. Rows are sorted in ranges, and only the ranges' sizes meet."""
    cut = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in cut.groupBy("_range").agg(F.count("*")).collect())  # a row for each partition
    before = df.sparkSession.createDataFrame(list(zip([r for r, _ in sizes], accumulate([0] + [n for _, n in sizes]))), "_range int, _base long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return cut.join(F.broadcast(before), "_range").withColumn(name, F.col("_base") + place).drop("_range", "_base")


def forget(df: DataFrame) -> None:
    """Removes the files of a table written by keep(), once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def let(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, which is evaluated once even where the optimizer copies the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores after it as it takes to be no column's."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
