"""The components of the index: raw monthly metric, optional cache, standardisation, reduction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drought import drought_monthly
from ..operators.frequency import temperature_frequency, wind_exceedance_frequency
from ..operators.mask import all_cells, apply_mask
from ..operators.rolling import max_precipitation
from ..operators.sealevel import clean, interpolate, region_mean
from ..operators.sealevel import standardize as standardize_gauges
from ..operators.standardize import admin_mean, standardize
from ..sources import cache

ENGINES = ("base", "terra")


def check_engine(engine: str) -> None:
    """Both names of the engine give the same plan; any other is refused before anything is read."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {', '.join(ENGINES)}, not {engine!r}")


@dataclass(frozen=True)
class Saved:
    """Where raw components are kept; ``computed`` reads them instead of computing."""

    folder: str
    study: tuple[str, str]
    computed: bool = False


def _raw(label: str, make: Callable[[], DataFrame], saved: Saved | None, spark: SparkSession) -> DataFrame:
    if saved is None:
        return make()
    if saved.computed:
        return cache.load(spark, saved.folder, label, saved.study)
    return cache.save(make(), saved.folder, label, saved.study)


def _masked(cube: DataFrame, cells: DataFrame | None, threshold: float) -> DataFrame:
    """Masked cells leave before any window or aggregate; the mask does not change in time."""
    return cube if cells is None else apply_mask(cube, cells, values=[], threshold=threshold, drop=True)


def finish(raw: DataFrame, *, reference: tuple[str, str], area: bool, weights: DataFrame | None, cells: DataFrame | None, out: str) -> DataFrame:
    """Standardise; with weights per cell and then averaged per unit, with ``area`` averaged first."""
    if weights is not None:
        return admin_mean(standardize(raw, reference=reference), weights, out=out)
    z = standardize(raw, reference=reference, area=area)
    if not area and cells is not None:
        z = all_cells(z, cells)
    return z.withColumnRenamed("value", out)


def temperature_raw(cube: DataFrame, *, reference, percentile=90, extremum="max", above=True, kernel="pandas") -> DataFrame:
    if extremum not in ("min", "max"):
        raise ValueError(f"extremum must be 'min' or 'max', not {extremum!r}")
    return temperature_frequency(cube, reference=reference, percentile=percentile, extremum=extremum, above=above, kernel=kernel)


def temperature_component(cube, *, reference, percentile=90, extremum="max", above=True, cells=None, threshold=0.8, area=False, weights=None, saved=None, kernel="pandas", engine="base") -> DataFrame:
    """Half the day's and half the night's frequency of crossings; column ``t<percentile>``."""
    check_engine(engine)
    out = f"t{int(percentile)}"
    raw = _raw(out, lambda: temperature_raw(_masked(cube, cells, threshold), reference=reference, percentile=percentile, extremum=extremum, above=above, kernel=kernel), saved, cube.sparkSession)
    return finish(raw, reference=reference, area=area, weights=weights, cells=cells, out=out)


def precipitation_component(cube, *, reference, window=5, cells=None, threshold=0.8, area=False, weights=None, saved=None, engine="base") -> DataFrame:
    check_engine(engine)
    raw = _raw("precipitation", lambda: max_precipitation(_masked(cube, cells, threshold), window=window), saved, cube.sparkSession)
    return finish(raw, reference=reference, area=area, weights=weights, cells=cells, out="precipitation")


def drought_component(cube, *, reference, cells=None, threshold=0.8, area=False, weights=None, saved=None, engine="base") -> DataFrame:
    check_engine(engine)
    raw = _raw("drought", lambda: drought_monthly(_masked(cube, cells, threshold)), saved, cube.sparkSession)
    return finish(raw, reference=reference, area=area, weights=weights, cells=cells, out="drought")


def wind_component(u, v=None, *, reference, cells=None, threshold=0.8, area=False, weights=None, saved=None, engine="base") -> DataFrame:
    check_engine(engine)

    def make():
        second = None if v is None else _masked(v, cells, threshold)
        return wind_exceedance_frequency(_masked(u, cells, threshold), second, reference=reference)

    raw = _raw("wind", make, saved, u.sparkSession)
    return finish(raw, reference=reference, area=area, weights=weights, cells=cells, out="wind")


def sealevel_component(obs, *, reference, study, area=True, cells=None, stations=None, max_dist_km=500, admin_stations=None, units=None, saved=None) -> DataFrame:
    """(month, sealevel), (unit, month, sealevel) or, without ``area``, (cell_id, month, sealevel).

    Units win over ``area``: with ``admin_stations`` the result is per unit.  What is saved
    is the cleaned record, which any reference period may standardise.
    """
    record = _raw("sealevel", lambda: clean(obs), saved, obs.sparkSession)
    anomalies = standardize_gauges(record, reference=reference, study=study)
    if admin_stations is not None:
        return region_mean(anomalies, admin_stations=admin_stations, units=units)
    if area:
        return region_mean(anomalies)
    if cells is None or stations is None:
        raise ValueError("the grid needs cells and stations")
    return interpolate(anomalies, cells, stations, max_dist_km=max_dist_km).select("cell_id", "month", F.col("value").alias("sealevel"))
