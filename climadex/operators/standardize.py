"""Standardisation against a reference period, and temporal granularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period_label
from ..schema import known, within_dates

TINY = 2.220446049250313e-16


def standardize(metric: DataFrame, *, reference: tuple[str, str], area: bool = False, value: str = "value") -> DataFrame:
    """z-scores per calendar month: (x - mean) / deviation of the reference.

    A missing or vanishing deviation counts as 1; no reference sample for a month gives NULL.
    ``area`` takes the unweighted mean over cells first and returns (month, value).  Rows are
    dealt by cell alone, which serves the window by (cell, calendar month) as well.
    """
    month = F.trunc(F.col("month"), "month").alias("month")
    if area:
        rows = metric.groupBy(month).agg(F.avg(known(value)).alias(value))
        by = Window.partitionBy(F.month("month"))
    else:
        rows = metric.select("cell_id", month, known(value).alias(value))
        by = Window.partitionBy("cell_id", F.month("month"))
    ref = F.when(within_dates(F.col("month"), reference), F.col(value))
    n, mean = F.count(ref).over(by), F.avg(ref).over(by)
    sd = F.when(n > 1, F.stddev_samp(ref).over(by))
    sd = F.when(sd.isNull() | (sd < TINY), F.lit(1.0)).otherwise(sd)
    return rows.withColumn(value, F.when(n > 0, (F.col(value) - mean) / sd))


def national_mean(metric: DataFrame, *, value: str = "value", out: str | None = None) -> DataFrame:
    """(month, value): unweighted mean over the cells that have a value."""
    return metric.groupBy(F.trunc(F.col("month"), "month").alias("month")).agg(F.avg(known(value)).alias(out or value))


def admin_mean(metric: DataFrame, weights: DataFrame, *, value: str = "value", out: str | None = None) -> DataFrame:
    """(unit, month, value): area-weighted mean over the cells of each unit that have a value.

    NULL where no cell has one.  A unit all of whose weights are 0 has NULL everywhere.
    """
    v, w = known(value), F.col("w")
    rows = metric.join(weights, "cell_id")
    total = F.sum(F.when(v.isNotNull() & (w != 0), w))
    mean = F.try_divide(F.sum(F.when(w != 0, w * v)), total)
    return rows.groupBy("unit", F.trunc(F.col("month"), "month").alias("month")).agg(mean.alias(out or value))


def aggregate_granularity(df: DataFrame, granularity: str, *, values: list[str], keys: tuple[str, ...] = (), time: str = "month", how=F.avg) -> DataFrame:
    """(keys, period, values): each column's mean over the period, NULLs skipped column by column."""
    label = period_label(F.to_date(F.col(time)), granularity)
    return df.groupBy(*keys, label.alias("period")).agg(*[how(F.col(v)).alias(v) for v in values])
