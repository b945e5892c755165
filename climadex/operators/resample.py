"""Daily and monthly reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import known

REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
DAY_HOURS = (6, 21)


def reducer(how: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A named reduction, or any function from a column to an aggregate."""
    if callable(how):
        return how
    if how not in REDUCERS:
        raise ValueError(f"unknown reduction {how!r}; use {', '.join(REDUCERS)} or a function")
    return REDUCERS[how]


def resample_daily(cube: DataFrame, value: str, how="mean", *, out: str | None = None) -> DataFrame:
    """(cell_id, day, value) per calendar day in UTC; NULLs are skipped, a day of NULLs only is NULL."""
    return cube.groupBy("cell_id", F.to_date("ts").alias("day")).agg(reducer(how)(known(value)).alias(out or value))


def resample_monthly(daily: DataFrame, value: str, how="mean", *, keys: tuple[str, ...] = ("cell_id",), time: str = "day", out: str | None = None) -> DataFrame:
    """(keys, month, value), stamped with the first of the month; ``keys=()`` for a plain series."""
    month = F.trunc(F.to_date(F.col(time)), "month").alias("month")
    return daily.groupBy(*keys, month).agg(reducer(how)(known(value)).alias(out or value))


def part_of_day(part: str, ts: Column | None = None) -> Column:
    """Condition for the hours of ``day`` (6 to 21 UTC) or ``night`` (all others)."""
    day = F.hour(F.col("ts") if ts is None else ts).between(*DAY_HOURS)
    if part == "day":
        return day
    if part == "night":
        return ~day
    raise ValueError(f"part must be 'day' or 'night', not {part!r}")


def temp_extremum(cube: DataFrame, value: str = "t2m", *, extremum: str, part: str, out: str | None = None) -> DataFrame:
    """Daily minimum or maximum over the hours of a part of the day."""
    if extremum not in ("min", "max"):
        raise ValueError(f"extremum must be 'min' or 'max', not {extremum!r}")
    return resample_daily(cube.where(part_of_day(part)), value, extremum, out=out)
