"""Consecutive dry days and their monthly interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resample import resample_daily

DRY_BELOW = 0.001


def max_consecutive_dry_days(cube: DataFrame, value: str = "tp") -> DataFrame:
    """(cell_id, year, cdd): longest dry run that ends in the year, from hourly metres of rain."""
    return consecutive_dry_days(resample_daily(cube, value, "sum", out="value"))


def consecutive_dry_days(daily: DataFrame) -> DataFrame:
    """Gaps and islands: a run carries over New Year; a wet day resets it, a NULL day breaks it.

    A year's value is NULL only if all its days are.
    """
    order = Window.partitionBy("cell_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    dry = F.when(F.col("value") < DRY_BELOW, 1).when(F.col("value").isNotNull(), 0)
    runs = daily.select("cell_id", "day", dry.alias("dry")).withColumn("run", F.sum(F.when(F.col("dry") == 1, 0).otherwise(1)).over(order))
    within_run = Window.partitionBy("cell_id", "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.when(F.col("dry").isNotNull(), F.coalesce(F.sum("dry").over(within_run), F.lit(0)))
    return runs.withColumn("streak", streak).groupBy("cell_id", F.year("day").alias("year")).agg(F.max("streak").cast("double").alias("cdd"))


def drought_interpolate(cdd: DataFrame) -> DataFrame:
    """(cell_id, month, value): each year's twelve months between its value and the next present year's.

    Month m weighs (12 - m) / 12 and m / 12; the last year repeats.  A NULL of either year
    makes all twelve NULL.
    """
    order = Window.partitionBy("cell_id").orderBy("year")
    last = F.lead("year").over(order).isNull()
    nxt = F.when(last, F.col("cdd")).otherwise(F.lead("cdd").over(order))
    rows = cdd.withColumn("next", nxt).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    value = (12 - F.col("m")) / 12.0 * F.col("cdd") + F.col("m") / 12.0 * F.col("next")
    return rows.select("cell_id", F.make_date("year", "m", F.lit(1)).alias("month"), value.alias("value"))


def drought_monthly(cube: DataFrame, value: str = "tp") -> DataFrame:
    return drought_interpolate(max_consecutive_dry_days(cube, value))
