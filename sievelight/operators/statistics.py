"""Run history and percentiles as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.display import sparkline

HISTORY = 100
RECENT = 3
SERIES = 30


def nearest_rank_by(df: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(group, count, avg, total, max, p..): nearest-rank percentiles without a list of values.

    Equal values are summed before the shuffle, and the window runs over
    different values only, so its size doesn't follow the rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(group)
    upto = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("n").over(by)})
    picks = []
    for p in percents:
        at = F.floor(F.lit(p / 100.0) * (F.col("_all") - 1) + 0.5)
        picks.append(F.min(F.when(F.col("_upto") > at, F.col(value))).alias(f"p{p}"))
    total = F.sum(F.col(value) * F.col("n"))
    return ranked.groupBy(group).agg(F.sum("n").alias("count"), (total / F.sum("n")).alias("avg"), total.alias("total"), F.max(value).alias("max"), *picks)


def last_runs(runs: DataFrame, group: str, order: list[str], keep: int = HISTORY) -> DataFrame:
    """The newest ``keep`` rows of each group, as a bounded history.

    Spark's rank limit is pushed below the shuffle (WindowGroupLimit), so a
    task sends no more than ``keep`` rows of a group.
    """
    newest = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    return runs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def recent_with_redactions(runs: DataFrame, count: str, order: list[str], keep: int = RECENT) -> DataFrame:
    """The newest runs that redacted anything; the limit is the report's own."""
    return runs.where(F.col(count) > 0).orderBy(*(F.desc(c) for c in order)).limit(keep)


def sparklines(history: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, series): a sparkline of each group's bounded history, oldest first."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))  # at most HISTORY rows a group
    series = history.groupBy(group).agg(rows.alias("rows"))
    return series.select(group, sparkline(F.transform("rows", lambda r: r["_v"].cast("double"))).alias("series"))
