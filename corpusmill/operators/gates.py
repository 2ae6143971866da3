"""Gates: ordered predicates (the first that fails names the reason) and gates that collect every reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the name of the first rule that holds, null if none. Rules keep their order, which defines the labels."""
    out = None
    for name, bad in rules:
        out = (F if out is None else out).when(bad, F.lit(name))
    return rows.withColumn("reason", out)


def all_reasons(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reasons: the names of all rules that hold."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])))


def report(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """reason and n; kept rows are 'kept'."""
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def reasons_report(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("kept"))).otherwise(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def guard(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows; evaluating a row that is bad fails the query with the message."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
