"""Threshold crossings and their monthly frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import wind_power as power
from ..schema import known, within_dates
from .resample import part_of_day, temp_extremum
from .rolling import part_thresholds, percentile_thresholds


def monthly_frequency(flags: DataFrame, *, flag: str = "flag") -> DataFrame:
    """(cell_id, month, value): flagged days over all days of the month present, NULL flags included.

    NULL only where all flags of the month are (a sum of NULLs is NULL).
    """
    return flags.groupBy("cell_id", F.trunc("day", "month").alias("month")).agg((F.sum(flag) / F.count(F.lit(1))).alias("value"))


def crossing_flags(daily: DataFrame, thresholds: DataFrame, value: str, *, above: bool) -> DataFrame:
    """(cell_id, day, flag): strictly above (or below) the threshold of the day of the year.

    A day without a threshold, or without a value, has a NULL flag.
    """
    joined = daily.withColumn("doy", F.dayofyear("day")).join(thresholds, ["cell_id", "doy"], "left")
    hit = F.col(value) > F.col("thr") if above else F.col(value) < F.col("thr")
    return joined.select("cell_id", "day", hit.cast("int").alias("flag"))


def halfday_frequency(cube: DataFrame, value: str = "t2m", *, reference: tuple[str, str], part: str, extremum: str, percentile: float, above: bool, kernel: str = "pandas") -> DataFrame:
    """Monthly frequency of daily extremes of a part of the day beyond its thresholds."""
    daily = temp_extremum(cube, value, extremum=extremum, part=part)
    thresholds = percentile_thresholds(cube, value, percentile=percentile, reference=reference, part=part, kernel=kernel)
    return monthly_frequency(crossing_flags(daily, thresholds, value, above=above))


def temperature_frequency(cube: DataFrame, value: str = "t2m", *, reference: tuple[str, str], percentile: float = 90, extremum: str = "max", above: bool = True, kernel: str = "pandas") -> DataFrame:
    """Mean of the day's and the night's monthly frequency."""
    how = {"reference": reference, "extremum": extremum, "percentile": percentile, "above": above, "kernel": kernel}
    day = halfday_frequency(cube, value, part="day", **how).withColumnRenamed("value", "d")
    night = halfday_frequency(cube, value, part="night", **how).withColumnRenamed("value", "n")
    return day.join(night, ["cell_id", "month"]).select("cell_id", "month", (0.5 * (F.col("d") + F.col("n"))).alias("value"))


def daily_table(hourly: DataFrame) -> DataFrame:
    """All daily reductions that the components start from, in one pass over (cell_id, ts, t2m, tp, u10, v10).

    Columns: cell_id, day; n, max and min of the hours of day and of night (``day_n``,
    ``day_max``, ...), sum of rain, mean wind vector.
    """
    t, columns = known("t2m"), []
    for part in ("day", "night"):
        own = part_of_day(part)
        columns += [F.count(F.when(own, 1)).alias(f"{part}_n"), F.max(F.when(own, t)).alias(f"{part}_max"), F.min(F.when(own, t)).alias(f"{part}_min")]
    columns += [F.sum(known("tp")).alias("tp"), F.avg(known("u10")).alias("u"), F.avg(known("v10")).alias("v")]
    return hourly.groupBy("cell_id", F.to_date("ts").alias("day")).agg(*columns)


def temperature_frequencies(daily: DataFrame, thresholds: DataFrame, *, high: str, low: str) -> DataFrame:
    """(cell_id, month, high, low): both temperature metrics from a ``daily_table``.

    ``thresholds`` are the ``part_thresholds`` of the low (0) and the high (1) percentile.
    Months without a day's or without a night's hours are left out.
    """
    joined = daily.withColumn("doy", F.dayofyear("day")).join(thresholds, ["cell_id", "doy"], "left")
    sums = []
    for part in ("day", "night"):
        there = F.col(f"{part}_n") > 0
        sums.append(F.count(F.when(there, 1)).alias(f"{part}_days"))
        for out, hit in ((high, F.col(f"{part}_max") > F.col(f"{part}_1")), (low, F.col(f"{part}_min") < F.col(f"{part}_0"))):
            sums.append(F.sum(F.when(there, hit.cast("int"))).alias(f"{part}_{out}"))
    monthly = joined.groupBy("cell_id", F.trunc("day", "month").alias("month")).agg(*sums).where("day_days > 0 and night_days > 0")

    def mean(out: str):
        return 0.5 * (F.col(f"day_{out}") / F.col("day_days") + F.col(f"night_{out}") / F.col("night_days"))

    return monthly.select("cell_id", "month", mean(high).alias(high), mean(low).alias(low))


def wind_power(u: DataFrame, v: DataFrame | None = None, *, reference: tuple[str, str] | None = None) -> DataFrame:
    """(cell_id, day, wp): power of the daily mean wind vector (means first, then the cube).

    ``u`` has u10, and v10 as well unless ``v`` brings it; days of both are kept.
    """
    if v is None:
        daily = u.groupBy("cell_id", F.to_date("ts").alias("day")).agg(F.avg(known("u10")).alias("u"), F.avg(known("v10")).alias("v"))
    else:
        a = u.groupBy("cell_id", F.to_date("ts").alias("day")).agg(F.avg(known("u10")).alias("u"))
        b = v.groupBy("cell_id", F.to_date("ts").alias("day")).agg(F.avg(known("v10")).alias("v"))
        daily = a.join(b, ["cell_id", "day"])
    if reference:
        daily = daily.where(within_dates(F.col("day"), reference))
    return daily.select("cell_id", "day", power(F.col("u"), F.col("v")).alias("wp"))


def wind_thresholds(wp: DataFrame, *, reference: tuple[str, str]) -> DataFrame:
    """``wp`` with ``thr``: mean plus 1.28 sample deviations of the reference per cell and day of the year.

    The statistics are conditional aggregates over a window, so the rows are dealt once by
    cell; a single reference year gives no deviation and so no threshold.
    """
    by = Window.partitionBy("cell_id", F.dayofyear("day"))
    ref = F.when(within_dates(F.col("day"), reference), F.col("wp"))
    # A window of single rows has no sample deviation: NULL, not NaN.
    sd = F.when(F.count(ref).over(by) > 1, F.stddev_samp(ref).over(by))
    return wp.withColumn("thr", F.avg(ref).over(by) + 1.28 * sd)


def wind_days_above(wp: DataFrame, *, reference: tuple[str, str]) -> DataFrame:
    """(cell_id, day, flag): 1 where the power is strictly above its threshold."""
    t = wind_thresholds(wp, reference=reference)
    return t.select("cell_id", "day", (F.col("wp") > F.col("thr")).cast("int").alias("flag"))


def wind_exceedance_frequency(u: DataFrame, v: DataFrame | None = None, *, reference: tuple[str, str]) -> DataFrame:
    return monthly_frequency(wind_days_above(wind_power(u, v), reference=reference))
