"""Cells against administrative polygons (planar, in degrees), and coastal fractions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def clip_to_box(ring: Ring, x0: float, y0: float, x1: float, y1: float) -> Ring:
    """The part of a simple polygon inside a rectangle: one side of the box at a time."""
    sides = ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1))
    for axis, at, sign in sides:
        out: Ring = []
        for p, q in zip(ring, [*ring[1:], *ring[:1]]):
            a, b = sign * (p[axis] - at), sign * (q[axis] - at)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            break
    return ring


def ring_area(ring: Ring) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], *ring[:1]]))) / 2


def build_admin_weights(cells: DataFrame, polygons: DataFrame, *, half_width: float = 0.25) -> DataFrame:
    """(cell_id, unit, w): share of each cell's square that lies in each unit.

    ``polygons`` has (unit, ring array<struct<lon, lat>>), several rows for a unit of several
    parts.  The square reaches ``half_width`` to each side of the cell's centre, so squares
    overlap when that exceeds half the grid step.  Cells and polygons meet by degree tiles of
    the polygon's bounding box.
    """
    if half_width <= 0:
        raise ValueError("half_width is positive")
    numbered = polygons.where(F.size("ring") > 2).withColumn("part", F.xxhash64("unit", F.to_json("ring")))
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    tiles = numbered.withColumn("tx", F.explode(F.sequence(F.floor(F.array_min(lon) - half_width), F.floor(F.array_max(lon) + half_width)))).withColumn(
        "ty", F.explode(F.sequence(F.floor(F.array_min(lat) - half_width), F.floor(F.array_max(lat) + half_width)))
    )
    pairs = cells.select("cell_id", "lon", "lat", F.floor("lon").alias("tx"), F.floor("lat").alias("ty")).join(tiles, ["tx", "ty"])

    @F.pandas_udf("double")
    def share(lon: pd.Series, lat: pd.Series, ring: pd.Series) -> pd.Series:
        out = []
        for x, y, r in zip(lon, lat, ring):
            points = [(p["lon"], p["lat"]) for p in r]
            if points[0] == points[-1]:
                points = points[:-1]
            out.append(ring_area(clip_to_box(points, x - half_width, y - half_width, x + half_width, y + half_width)))
        return pd.Series(out) / (2 * half_width) ** 2

    got = pairs.select("cell_id", "unit", "part", share("lon", "lat", "ring").alias("w")).where(F.col("w") > 0)
    return got.groupBy("cell_id", "unit").agg(F.least(F.sum("w"), F.lit(1.0)).alias("w"))


def coastal_alpha(units: DataFrame) -> DataFrame:
    """(unit, alpha) from (unit, coast_km, perimeter_km): coastal share of the border, 1 at most."""
    alpha = F.least(F.try_divide(F.coalesce("coast_km", F.lit(0.0)), F.col("perimeter_km")), F.lit(1.0))
    return units.select("unit", F.coalesce(alpha, F.lit(0.0)).alias("alpha"))


def bbox_with_margin(cells: DataFrame, *, share: float = 0.05) -> DataFrame:
    """(lon_min, lon_max, lat_min, lat_max), widened by a share of the range."""
    ends = cells.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    dx, dy = (F.col("b") - F.col("a")) * share, (F.col("d") - F.col("c")) * share
    return ends.select((F.col("a") - dx).alias("lon_min"), (F.col("b") + dx).alias("lon_max"), (F.col("c") - dy).alias("lat_min"), (F.col("d") + dy).alias("lat_max"))


def ring_length_km(ring: Ring) -> float:
    """Great-circle length of a closed ring."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]]):
        a, b = math.radians(y1), math.radians(y2)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x2 - x1) / 2) ** 2
        total += 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))
    return total
