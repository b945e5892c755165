"""The composite index in its three spatial modes."""

from __future__ import annotations

from functools import cache, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import wind_power as power
from ..operators.drought import consecutive_dry_days, drought_interpolate
from ..operators.frequency import daily_table, monthly_frequency, temperature_frequencies, wind_days_above
from ..operators.rolling import max_precipitation_daily, part_thresholds, percentile_thresholds
from ..operators.standardize import aggregate_granularity
from ..schema import require
from .components import Saved, _masked, _raw, check_engine, finish, sealevel_component

GRIDDED = ("precipitation", "drought", "wind")


def merge_series(frames: list[DataFrame], on: list[str] | str = "month") -> DataFrame:
    """Inner join of series on their common months."""
    return reduce(lambda a, b: a.join(b, on), frames)


def _sum(high: str, low: str):
    return F.col(high) - F.col(low) + F.col("precipitation") + F.col("drought") + F.col("wind")


def combine_national(high: DataFrame, low: DataFrame, precipitation: DataFrame, drought: DataFrame, wind: DataFrame, sealevel: DataFrame, *, high_col: str = "t90", low_col: str = "t10", factor: float = 0.2) -> DataFrame:
    """(month, components, aci) over the months that all components have."""
    if high_col == low_col:
        raise ValueError("the two temperature columns need different names")
    joined = merge_series([high, low, precipitation, drought, wind, sealevel])
    aci = (_sum(high_col, low_col) + factor * F.col("sealevel")) / (5 + factor)
    return joined.withColumn("aci", aci)


def combine_grid(high: DataFrame, low: DataFrame, precipitation: DataFrame, drought: DataFrame, wind: DataFrame, sealevel: DataFrame | None = None, *, high_col: str = "t90", low_col: str = "t10") -> DataFrame:
    """(cell_id, month, components, aci); the months are those of the hot temperatures.

    A cell takes part in the sea level (denominator 6) if it has one in the first month of
    the sea-level record, for good: a later NULL adds nothing, a later value elsewhere is
    not used.  The sea level itself is returned as it came, 0 if there is none at all.
    """
    keys = ["cell_id", "month"]
    out = high
    for part in (low, precipitation, drought, wind):
        out = out.join(part, keys, "left")
    if sealevel is None:
        out = out.withColumns({"sealevel": F.lit(0.0), "alpha": F.lit(0)})
    else:
        first = sealevel.groupBy("cell_id").agg(F.min_by("sealevel", "month").alias("first"))
        out = out.join(sealevel, keys, "left").join(first, "cell_id", "left").withColumn("alpha", F.when(F.col("first").isNotNull(), 1).otherwise(0)).drop("first")
    level = F.when(F.col("alpha") == 1, F.coalesce("sealevel", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("aci", (_sum(high_col, low_col) + level) / (5 + F.col("alpha"))).drop("alpha")


def combine_admin(high: DataFrame, low: DataFrame, precipitation: DataFrame, drought: DataFrame, wind: DataFrame, sealevel: DataFrame, alpha: DataFrame, *, high_col: str = "t90", low_col: str = "t10", strict: bool = True) -> DataFrame:
    """(unit, month, components, aci), weighted by the coastal fraction of each unit.

    A coastal unit without a sea level has a NULL index if ``strict``; otherwise it counts as
    one without a coast.
    """
    keys = ["unit", "month"]
    out = high
    for part in (low, precipitation, drought, wind, sealevel):
        out = out.join(part, keys, "left")
    out = out.join(alpha, "unit", "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    if not strict:
        out = out.withColumn("alpha", F.when(F.col("sealevel").isNull(), 0.0).otherwise(F.col("alpha")))
    level = F.when(F.col("alpha") == 0, 0.0).otherwise(F.col("alpha") * F.col("sealevel"))
    return out.withColumn("aci", (_sum(high_col, low_col) + level) / (5 + F.col("alpha"))).drop("alpha")


def raw_components(hourly: DataFrame, cells: DataFrame | None, threshold: float, *, reference: tuple[str, str], percentile_high: float, percentile_low: float, high_col: str, low_col: str, kernel: str):
    """A function that gives the raw gridded components by name; they share two passes over the hours.

    One pass makes the daily table, dealt by cell and persisted (1/24 of the rows; it stays
    until it is unpersisted or the session ends); the other one, over the hours of the
    reference period, makes the thresholds of both percentiles and parts of the day.
    """

    @cache
    def make() -> dict[str, DataFrame]:
        masked = _masked(hourly, cells, threshold)
        daily = daily_table(masked).repartition("cell_id").persist(StorageLevel.MEMORY_AND_DISK)
        if kernel == "pandas":
            thresholds = part_thresholds(masked, percentiles=(percentile_low, percentile_high), reference=reference)
        else:
            parts = [
                percentile_thresholds(masked, percentile=p, reference=reference, part=part, kernel=kernel).withColumnRenamed("thr", f"{part}_{k}")
                for part in ("day", "night")
                for k, p in enumerate((percentile_low, percentile_high))
            ]
            thresholds = reduce(lambda a, b: a.join(b, ["cell_id", "doy"], "full"), parts)
        warm = temperature_frequencies(daily, thresholds, high=high_col, low=low_col)
        rain = daily.select("cell_id", "day", F.col("tp").alias("value"))
        wp = daily.select("cell_id", "day", power(F.col("u"), F.col("v")).alias("wp"))
        return {
            high_col: warm.select("cell_id", "month", F.col(high_col).alias("value")),
            low_col: warm.select("cell_id", "month", F.col(low_col).alias("value")),
            "precipitation": max_precipitation_daily(rain),
            "drought": drought_interpolate(consecutive_dry_days(rain)),
            "wind": monthly_frequency(wind_days_above(wp, reference=reference)),
        }

    return make


def calculate_index(
    hourly: DataFrame,
    obs: DataFrame,
    *,
    reference: tuple[str, str],
    study: tuple[str, str],
    cells: DataFrame | None = None,
    stations: DataFrame | None = None,
    admin_weights: DataFrame | None = None,
    admin_stations: DataFrame | None = None,
    admin_alpha: DataFrame | None = None,
    area: bool = True,
    percentile_high: float = 90,
    percentile_low: float = 10,
    factor: float = 0.2,
    granularity: str = "month",
    max_dist_km: float = 500,
    threshold: float = 0.8,
    folder: str | None = None,
    computed: bool = False,
    strict: bool = True,
    kernel: str = "pandas",
    engine: str = "base",
) -> DataFrame:
    """The index from hourly cubes and gauge records.

    ``admin_weights`` (with ``admin_stations`` and ``admin_alpha``) gives a row per unit and
    period, ``area`` one per period, neither one per cell and period.  ``folder`` keeps the raw
    components as Parquet and ``computed`` starts from them.  The hours are read twice at most
    (see ``raw_components``).  ``hourly`` may come from any source with the columns of
    ``schema.CLIMATE_HOURLY``, prepared Parquet cubes among them.  Coarser periods are means of
    the monthly rows, column by column.
    """
    check_engine(engine)
    admin = admin_weights is not None
    if admin and (admin_stations is None or admin_alpha is None):
        raise ValueError("units need admin_stations and admin_alpha")
    if computed and folder is None:
        raise ValueError("computed components need their folder")
    require(hourly, "cell_id", "ts", "t2m", "tp", "u10", "v10")
    require(obs, "station_id", "month", "level")
    high_col, low_col = f"t{int(percentile_high)}", f"t{int(percentile_low)}"
    saved = Saved(folder, study, computed) if folder else None
    raws = raw_components(hourly, cells, threshold, reference=reference, percentile_high=percentile_high, percentile_low=percentile_low, high_col=high_col, low_col=low_col, kernel=kernel)

    def component(label: str) -> DataFrame:
        raw = _raw(label, lambda: raws()[label], saved, hourly.sparkSession)
        return finish(raw, reference=reference, area=area, weights=admin_weights, cells=cells, out=label)

    high, low, rain, dry, wind = (component(label) for label in (high_col, low_col, *GRIDDED))
    values = [high_col, low_col, *GRIDDED, "sealevel", "aci"]
    if admin:
        level = sealevel_component(obs, reference=reference, study=study, admin_stations=admin_stations, units=admin_alpha, saved=saved)
        out = combine_admin(high, low, rain, dry, wind, level, admin_alpha, high_col=high_col, low_col=low_col, strict=strict)
        keys = ("unit",)
    elif area:
        level = sealevel_component(obs, reference=reference, study=study, saved=saved)
        out = combine_national(high, low, rain, dry, wind, level, high_col=high_col, low_col=low_col, factor=factor)
        keys = ()
    else:
        level = sealevel_component(obs, reference=reference, study=study, area=False, cells=cells, stations=stations, max_dist_km=max_dist_km, saved=saved)
        out = combine_grid(high, low, rain, dry, wind, level, high_col=high_col, low_col=low_col)
        keys = ("cell_id",)
    return aggregate_granularity(out, granularity, values=values, keys=keys)


def wide_by_unit(index: DataFrame, units: list[str], values: list[str]) -> DataFrame:
    """One row per period, columns ``<value>_<unit>``: for the edge of the API only."""
    return index.groupBy("period").agg(*[F.max(F.when(F.col("unit") == u, F.col(v))).alias(f"{v}_{u}") for u in units for v in values]).orderBy("period")
