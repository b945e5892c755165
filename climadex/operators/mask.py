"""Country masks and cell assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import haversine_km


def apply_mask(cube: DataFrame, cells: DataFrame, *, values: list[str], threshold: float = 0.8, drop: bool = False) -> DataFrame:
    """Values of cells whose land fraction is below the threshold (or unknown) become NULL.

    ``drop`` leaves those rows out at once, which lets the join prune the scan; rejoin the
    cells afterwards with ``all_cells`` where NULL rows are wanted.  The table of cells has a
    row per cell; Spark broadcasts it when its statistics say it is small.
    """
    keep = cells.select("cell_id", (F.col("land_frac") >= threshold).alias("__keep"))
    if drop:
        return cube.join(keep.where("__keep").select("cell_id"), "cell_id", "left_semi")
    joined = cube.join(keep, "cell_id", "left")
    return joined.withColumns({v: F.when(F.col("__keep"), F.col(v)) for v in values}).drop("__keep")


def all_cells(metric: DataFrame, cells: DataFrame, *, time: str = "month") -> DataFrame:
    """One row for each cell and each time of the metric, NULL where it has none."""
    frame = cells.select("cell_id").join(metric.select(time).distinct())
    return frame.join(metric, ["cell_id", time], "left")


#: Tiles, in degrees, in which the nearest mask point is looked for: coarser ones where the
#: finer ones cannot be sure of it.  Each divides 360; the last reaches everywhere.
TILES = (1, 15, 180)


def nearest_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Land fraction of each cell from the nearest point of a mask of any other geometry.

    ``mask`` has (lon, lat, land_frac); distances are planar in degrees, longitudes go round
    at 360.  Candidates come from the tiles around the cell, so the join is on keys: two tiles
    to each side are sure of a point up to two tiles away, and only cells without such a point
    are looked up again in coarser tiles.  Of points equally near the least (lon, lat) counts.
    """
    points = mask.select(F.col("lon").alias("mlon"), F.col("lat").alias("mlat"), F.col("land_frac").alias("mfrac")).where(F.col("mlon").isNotNull() & F.col("mlat").isNotNull())
    best = F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("mlon"), F.lit(None).cast("double").alias("mlat"), F.lit(None).cast("double").alias("mfrac"))
    state = cells.select("cell_id", "lon", "lat", F.when(F.lit(False), best).alias("best"))
    sure = 0

    def across(lon, size):
        return F.pmod(F.floor(lon / size), F.lit(360 // size))

    for size in TILES:
        around = F.array_distinct(
            F.array(*[F.struct(across(F.col("lon") + F.lit(i * size), size).alias("gx"), (F.floor(F.col("lat") / size) + j).alias("gy")) for i in range(-2, 3) for j in range(-2, 3)])
        )
        open_ = F.col("best").isNull() | (F.col("best.d") > sure**2)
        own = state.select("cell_id", "lon", "lat", "best", F.explode_outer(F.when(open_, around)).alias("g")).select("cell_id", "lon", "lat", "best", "g.gx", "g.gy")
        there = points.select("*", across(F.col("mlon"), size).alias("gx"), F.floor(F.col("mlat") / size).alias("gy"))
        dx = F.pmod(F.abs(F.col("lon") - F.col("mlon")), F.lit(360.0))
        d = F.pow(F.least(dx, 360.0 - dx), 2) + F.pow(F.col("lat") - F.col("mlat"), 2)
        found = F.when(d.isNotNull(), F.struct(d.alias("d"), F.col("mlon").cast("double").alias("mlon"), F.col("mlat").cast("double").alias("mlat"), F.col("mfrac").cast("double").alias("mfrac")))
        near = own.join(there, ["gx", "gy"], "left").select("cell_id", "lon", "lat", F.least("best", found).alias("best"))
        state = near.groupBy("cell_id", "lon", "lat").agg(F.min("best").alias("best"))
        sure = 2 * size
    return cells.drop("land_frac").join(state.select("cell_id", F.col("best.mfrac").alias("land_frac")), "cell_id", "left")


def nearest_unit(stations: DataFrame, units: DataFrame) -> DataFrame:
    """(station_id, unit): each station goes to the unit of nearest reference point (unit, lon, lat).

    Units and stations are reference tables of a few thousand rows.
    """
    u = units.select("unit", F.col("lon").alias("ulon"), F.col("lat").alias("ulat"))
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("ulon"), F.col("ulat"))
    w = Window.partitionBy("station_id").orderBy("d", "unit")
    return stations.join(u).withColumn("d", d).withColumn("r", F.row_number().over(w)).where("r = 1").select("station_id", "unit")


def assign_stations(stations: DataFrame, units: DataFrame, coast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit, station_id) and (unit, alpha): gauges by nearest unit, coastal shares of all units.

    ``units`` has reference points (unit, lon, lat), ``coast`` shares (unit, alpha); a unit
    without one has none.  Coastal units without a gauge are an error.
    """
    dealt = nearest_unit(stations, units).select("unit", "station_id")
    alpha = units.select("unit").distinct().join(coast.select("unit", "alpha"), "unit", "left").select("unit", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
    # A row per unit at most.
    dry = [r["unit"] for r in alpha.where("alpha > 0").join(dealt, "unit", "left_anti").orderBy("unit").collect()]
    if dry:
        raise ValueError(f"coastal units without a gauge: {', '.join(map(str, dry))}")
    return dealt, alpha
