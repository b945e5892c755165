"""Tables of the engine.  A cube is a long table keyed by (cell_id, time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIMATE_HOURLY = "cell_id int, ts timestamp_ntz, t2m double, tp double, u10 double, v10 double"
GRID_CELLS = "cell_id int, lon double, lat double, land_frac double"
ADMIN_WEIGHTS = "cell_id int, unit string, w double"
ADMIN_ALPHA = "unit string, alpha double"
ADMIN_STATIONS = "unit string, station_id int"
STATIONS = "station_id int, country string, lat double, lon double"
SEALEVEL_OBS = "station_id int, month date, level double"
COMPONENT_GRID = "component string, cell_id int, month date, value double"

COMPONENTS = ("precipitation", "drought", "wind", "sealevel")


def cell_id(lon_index: Column, lat_index: Column, n_lat: int) -> Column:
    """Index of a grid cell; joins never compare floating-point coordinates."""
    return (lon_index * n_lat + lat_index).cast("int")


def known(value: Column | str) -> Column:
    """The value as a double with NaN and infinities as NULL; NULL is the only missing value here."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def period(start_end: tuple[str, str]) -> tuple[str, str]:
    """A checked pair of ISO dates."""
    start, end = start_end
    if not start <= end:
        raise ValueError("a period is (start, end) with start <= end")
    return start, end


def within(time: Column, start_end: tuple[str, str]) -> Column:
    """Inclusive at both ends at midnight: of the last day only the 00:00 sample is in."""
    start, end = period(start_end)
    return (time >= F.lit(start).cast("timestamp_ntz")) & (time <= F.lit(end).cast("timestamp_ntz"))


def within_dates(day: Column, start_end: tuple[str, str]) -> Column:
    start, end = period(start_end)
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
