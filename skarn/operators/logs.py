"""Aggregates over append-only logs: totals with subtotals, medians over sources, running sums, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(log: DataFrame, stage: str, value: str) -> DataFrame:
    """stage (null: all), calls, total: sums per stage and over all, in one pass of grouping sets."""
    return log.select(F.col(stage).alias("stage"), F.col(value).alias("v")).rollup("stage").agg(F.count("*").alias("calls"), F.round(F.sum("v"), 4).alias("total"), F.grouping("stage").alias("g")).where((F.col("g") == 1) | F.col("stage").isNotNull()).drop("g")


def spread_of_totals(log: DataFrame, source: str, value: str) -> DataFrame:
    """sources, median, least, most of the sums per source."""
    per = log.groupBy(F.col(source).alias("s")).agg(F.round(F.sum(value), 4).alias("total"))
    return per.agg(F.count("*").alias("sources"), F.round(F.percentile("total", F.lit(0.5)), 4).alias("median"), F.min("total").alias("least"), F.max("total").alias("most"))


def within_budget(log: DataFrame, source: str, order: list[str], value: str, budget: float) -> DataFrame:
    """Rows whose source had spent less than the budget before them; the row that oversteps it is still in."""
    before = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.round(F.sum(value).over(before), 4), F.lit(0.0))
    return log.withColumn("spent_before", spent).where(F.col("spent_before") < budget)


def sessions(log: DataFrame, source: str, at: str, gap_seconds: int = 600) -> DataFrame:
    """source, session, started, ended, n: runs of rows without a gap of over gap_seconds."""
    order = Window.partitionBy(source).orderBy(at)
    seconds = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(order))
    marked = log.withColumn("__new", F.when(seconds.isNull() | (seconds > gap_seconds), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(source, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without an entry in done."""
    return items.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def resolved(items: DataFrame, verdicts: DataFrame, key: str, label: str, order: list) -> DataFrame:
    """Items with the last verdict of their key, if any, in place of their own label; decided_by tells which."""
    from skarn.operators.identity import latest

    last = latest(verdicts, [key], order).select(key, F.col(label).alias("__verdict"))
    return items.join(last, key, "left").withColumn("decided_by", F.when(F.col("__verdict").isNotNull(), "recorded").otherwise("signals")).withColumn(label, F.coalesce("__verdict", label)).drop("__verdict")
