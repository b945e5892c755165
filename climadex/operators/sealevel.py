"""Tide-gauge records: cleaning, standardisation, regions, interpolation to the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.physics import haversine_km
from ..schema import known, within_dates
from .standardize import TINY

MISSING = -99999.0


def clean(obs: DataFrame) -> DataFrame:
    """The sentinel becomes NULL."""
    return obs.withColumn("level", F.nullif(known("level"), F.lit(MISSING)))


def monthly_stats(obs: DataFrame, *, reference: tuple[str, str]) -> DataFrame:
    """(moy, mean, sd): stations are averaged per month first, then months per calendar month."""
    monthly = obs.where(within_dates(F.col("month"), reference)).groupBy("month").agg(F.avg("level").alias("level"))
    sd = F.when(F.count("level") > 1, F.stddev_samp("level"))
    stats = monthly.groupBy(F.month("month").alias("moy")).agg(F.avg("level").alias("mean"), sd.alias("sd"))
    return stats.withColumn("sd", F.when(F.col("sd").isNull() | (F.col("sd") < TINY), 1.0).otherwise(F.col("sd")))


def monthly_stat(obs: DataFrame, *, reference: tuple[str, str], stats: str) -> DataFrame:
    """One of the two statistics, ``means`` or ``std``, by calendar month."""
    if stats not in ("means", "std"):
        raise ValueError("stats must be 'means' or 'std'")
    return monthly_stats(obs, reference=reference).select("moy", F.col("mean" if stats == "means" else "sd").alias("value"))


def standardize(obs: DataFrame, *, reference: tuple[str, str], study: tuple[str, str]) -> DataFrame:
    """(station_id, month, value) of the study period; the scale is the country's, not the station's.

    Months in which no station has a value are left out.
    """
    stats = monthly_stats(obs, reference=reference)
    rows = obs.where(within_dates(F.col("month"), study)).withColumn("moy", F.month("month"))
    out = rows.join(F.broadcast(stats), "moy", "left")  # twelve rows at most
    return out.select("station_id", "month", ((F.col("level") - F.col("mean")) / F.col("sd")).alias("value")).where(F.col("value").isNotNull())


def region_mean(anomalies: DataFrame, *, admin_stations: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """(month, sealevel), or (unit, month, sealevel) for all ``units``, NULL for those without a station."""
    if admin_stations is None:
        return anomalies.groupBy("month").agg(F.avg("value").alias("sealevel"))
    found = anomalies.join(admin_stations, "station_id").groupBy("unit", "month").agg(F.avg("value").alias("sealevel"))
    names = (units if units is not None else admin_stations).select("unit").distinct()
    frame = names.join(anomalies.select("month").distinct())  # units x months, both reference-sized
    return frame.join(found, ["unit", "month"], "left")


def idw_weights(cells: DataFrame, stations: DataFrame, *, max_dist_km: float = 500, power: float = 2) -> DataFrame:
    """(cell_id, station_id, w): inverse-distance weights of the stations in reach of each cell.

    Cells and stations meet by bands of latitude as wide as the reach, so the join is on keys
    and only neighbouring bands are compared.
    """
    band = max(max_dist_km / 111.0, 1e-3)
    s = stations.select("station_id", F.col("lon").alias("slon"), F.col("lat").alias("slat"), F.floor(F.col("lat") / band).alias("band"))
    c = cells.select("cell_id", "lon", "lat", F.explode(F.sequence(F.floor(F.col("lat") / band) - 1, F.floor(F.col("lat") / band) + 1)).alias("band"))
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    near = c.join(s, "band").withColumn("d", d).where(F.col("d") <= max_dist_km)
    return near.select("cell_id", "station_id", (1 / F.pow(F.greatest("d", F.lit(0.001)), F.lit(power))).alias("w"))


def interpolate(anomalies: DataFrame, cells: DataFrame, stations: DataFrame, *, max_dist_km: float = 500, power: float = 2) -> DataFrame:
    """(cell_id, month, value): weights renormalised over the stations with data that month.

    Every cell has every month; NULL where no station in reach has data.
    """
    weights = idw_weights(cells, stations, max_dist_km=max_dist_km, power=power)
    # Stations first: months of a station are few, cells may be many.
    found = weights.join(anomalies.where(F.col("value").isNotNull()), "station_id").groupBy("cell_id", "month").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    frame = cells.select("cell_id").join(anomalies.select("month").distinct())
    return frame.join(found, ["cell_id", "month"], "left")
