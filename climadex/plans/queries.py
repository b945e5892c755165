"""Registered queries of the climate engine on the test data, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import gauge_month, label_date
from ..operators import drought, frequency, mask, resample, rolling, sealevel, spatial, standardize
from ..sources.gauges import load_gauges
from ..sources.netcdf3 import describe_times
from ..streaming import daily
from . import components, index, plots
from . import testdata as td

REF, STUDY = td.REFERENCE, td.STUDY
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for a comparison of engines that add in different orders."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _hourly(f: Callable[[DataFrame], DataFrame], digits: int = DIGITS):
    return lambda spark, d: rounded(f(td.hourly(spark, d)), digits)


def _index(spark: SparkSession, d: str, **how) -> DataFrame:
    return index.calculate_index(td.hourly(spark, d), td.sealevel_obs(spark, d), reference=REF, study=STUDY, threshold=td.THRESHOLD, **how)


def national(spark: SparkSession, d: str, granularity: str = "month") -> DataFrame:
    return _index(spark, d, granularity=granularity)


def grid(spark: SparkSession, d: str, granularity: str = "season") -> DataFrame:
    return _index(spark, d, granularity=granularity, area=False, cells=td.grid_cells(spark, d), stations=td.stations(spark, d))


def admin(spark: SparkSession, d: str, granularity: str = "year") -> DataFrame:
    return _index(spark, d, granularity=granularity, admin_weights=td.admin_weights(spark, d), admin_stations=td.admin_stations(spark, d), admin_alpha=td.admin_alpha(spark))


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    return sealevel.standardize(sealevel.clean(td.sealevel_obs(spark, d)), reference=REF, study=STUDY)


def _precip(h: DataFrame) -> DataFrame:
    return rolling.max_precipitation(h)


def _gauge_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.lpad(((F.col("n_nationkey") % 12) * 3).cast("string"), 2, "0")
    text = F.concat(F.lit("20"), k, F.element_at(F.array(*map(F.lit, [".0417", ".1250", ".2083", "", ".5", ".9583", ".875"])), (F.col("n_nationkey") % 7 + 1).cast("int")))
    return td._t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("station_id"), text.alias("text"), gauge_month(text).alias("month"))


def _precipitation_saved(spark: SparkSession, d: str) -> DataFrame:
    """The component out of what a first call with another reference period has kept of the rain."""
    folder, h = td.shared_folder(spark), td.hourly(spark, d)
    components.precipitation_component(h, reference=STUDY, saved=components.Saved(folder, STUDY))
    return components.precipitation_component(h.limit(0), reference=REF, saved=components.Saved(folder, STUDY, computed=True))


def _sealevel_saved(spark: SparkSession, d: str) -> DataFrame:
    """Sea level of the reference period out of a record kept under another one."""
    folder, obs = td.shared_folder(spark), td.sealevel_obs(spark, d)
    components.sealevel_component(obs, reference=STUDY, study=STUDY, saved=components.Saved(folder, STUDY))
    return components.sealevel_component(obs.limit(0), reference=REF, study=STUDY, saved=components.Saved(folder, STUDY, computed=True))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Days that a stream over the hours has closed: those that end a day before the last hour."""
    folder = td.shared_folder(spark)
    td.hourly(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(8).write.parquet(f"{folder}/in")
    days = daily.daily_stream(daily.read_hourly(spark, f"{folder}/in"), "t2m", "mean")
    daily.write_daily(days, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _label_dates(spark: SparkSession, d: str) -> DataFrame:
    months = td.hourly(spark, d).select(F.trunc("ts", "month").alias("month")).distinct()
    from ..functions.dates import period_label

    kinds = F.array(*[F.struct(F.lit(g).alias("granularity"), period_label(F.col("month"), g).alias("period")) for g in ("month", "season", "semester", "year")])
    return months.select(F.explode(kinds).alias("x")).select("x.*").distinct().withColumn("date", label_date(F.col("period")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"resample_daily_{how}": _hourly(lambda h, how=how: resample.resample_daily(h, "tp", how, out="value"), 14) for how in ("sum", "mean", "min", "max")},
    "resample_monthly_mean": _hourly(lambda h: resample.resample_monthly(resample.resample_daily(h, "t2m", "mean", out="value"), "value", "mean")),
    **{f"temp_extremum_{p}_{e}": _hourly(lambda h, p=p, e=e: resample.temp_extremum(h, extremum=e, part=p, out="value")) for p in ("day", "night") for e in ("min", "max")},
    "rolling_sum_5d": _hourly(lambda h: rolling.rolling_sum(resample.resample_daily(h, "tp", "sum", out="value"), "value", 5), 10),
    "precip_max_5d": _hourly(_precip, 10),
    **{f"temp_percentiles_{p}": _hourly(lambda h, p=p: rolling.percentile_thresholds(h, percentile=90, reference=REF, part=p)) for p in ("day", "night")},
    "temp_percentiles_kernel": _hourly(lambda h: rolling.percentile_thresholds(h, percentile=90, reference=REF, part="night", kernel="pandas")),
    "halfday_frequency_hot": _hourly(lambda h: frequency.halfday_frequency(h, reference=REF, part="day", extremum="max", percentile=90, above=True)),
    "halfday_frequency_cold": _hourly(lambda h: frequency.halfday_frequency(h, reference=REF, part="night", extremum="min", percentile=10, above=False)),
    "temperature_t90": _hourly(lambda h: components.temperature_component(h, reference=REF, percentile=90, extremum="max", above=True)),
    "temperature_t10": _hourly(lambda h: components.temperature_component(h, reference=REF, percentile=10, extremum="min", above=False)),
    "wind_power": _hourly(lambda h: frequency.wind_power(h)),
    "wind_thresholds": _hourly(lambda h: frequency.wind_thresholds(frequency.wind_power(h), reference=REF)),
    "wind_days_above": _hourly(lambda h: frequency.wind_days_above(frequency.wind_power(h), reference=REF).withColumn("flag", F.col("flag").cast("double"))),
    "wind_frequency": _hourly(lambda h: frequency.wind_exceedance_frequency(h, reference=REF)),
    "cdd_annual": _hourly(lambda h: drought.max_consecutive_dry_days(h)),
    "drought_monthly": _hourly(lambda h: drought.drought_monthly(h)),
    "standardize_grid": _hourly(lambda h: standardize.standardize(_precip(h), reference=REF)),
    "standardize_area": _hourly(lambda h: standardize.standardize(_precip(h), reference=REF, area=True)),
    "national_mean": _hourly(lambda h: standardize.national_mean(_precip(h)), 10),
    "granularity_season": _hourly(lambda h: standardize.aggregate_granularity(standardize.standardize(_precip(h), reference=REF), "season", values=["value"], keys=("cell_id",))),
    "admin_weighted_mean": lambda s, d: rounded(standardize.admin_mean(standardize.standardize(_precip(td.hourly(s, d)), reference=REF), td.admin_weights(s, d))),
    "mask_cells": lambda s, d: rounded(mask.apply_mask(resample.resample_daily(td.hourly(s, d), "t2m", "mean", out="value"), td.grid_cells(s, d), values=["value"], threshold=td.THRESHOLD)),
    "mask_drop_and_rejoin": lambda s, d: rounded(mask.all_cells(_precip(mask.apply_mask(td.hourly(s, d), td.grid_cells(s, d), values=[], threshold=td.THRESHOLD, drop=True)), td.grid_cells(s, d)), 10),
    "time_resolution": lambda s, d: describe_times(td.hourly(s, d)),
    "time_resolution_daily": lambda s, d: describe_times(resample.resample_daily(td.hourly(s, d), "t2m").withColumn("ts", F.col("day").cast("timestamp_ntz"))),
    "daily_table": _hourly(frequency.daily_table, 10),
    "temp_percentiles_native": _hourly(lambda h: rolling.percentile_thresholds(h, percentile=10, reference=REF, part="night", kernel="native")),
    "plot_density": lambda s, d: rounded(plots.density(national(s, d, "month"), components=["wind"], include_index=False, points=16)),
    "union_along_time": lambda s, d: td.hourly(s, d).where("ts < '1998-01-01'").unionByName(td.hourly(s, d).where("ts >= '1998-01-01'")).groupBy("cell_id", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n")),
    "gauge_dates": _gauge_dates,
    "sealevel_clean": lambda s, d: rounded(sealevel.clean(td.sealevel_obs(s, d)), 8),
    "gauge_files": lambda s, d: rounded(sealevel.clean(load_gauges(s, td.gauge_folder(s, d))), 8),
    "precipitation_saved": lambda s, d: rounded(_precipitation_saved(s, d)),
    "sealevel_saved": lambda s, d: rounded(_sealevel_saved(s, d)),
    "stream_daily": lambda s, d: rounded(_stream(s, d)),
    "sealevel_monthly_stats": lambda s, d: rounded(sealevel.monthly_stats(sealevel.clean(td.sealevel_obs(s, d)), reference=REF), 4),
    "sealevel_standardize": lambda s, d: rounded(_anomalies(s, d)),
    "sealevel_region": lambda s, d: rounded(sealevel.region_mean(_anomalies(s, d))),
    "sealevel_units": lambda s, d: rounded(sealevel.region_mean(_anomalies(s, d), admin_stations=td.admin_stations(s, d), units=td.admin_alpha(s))),
    "idw_sealevel": lambda s, d: rounded(sealevel.interpolate(_anomalies(s, d), td.grid_cells(s, d), td.stations(s, d))),
    "idw_sealevel_150km": lambda s, d: rounded(sealevel.interpolate(_anomalies(s, d), td.grid_cells(s, d), td.stations(s, d), max_dist_km=150)),
    "nearest_unit": lambda s, d: mask.nearest_unit(td.stations(s, d), td.grid_cells(s, d).select(F.concat(F.lit("C"), F.col("cell_id").cast("string")).alias("unit"), "lon", "lat")),
    "nearest_mask": lambda s, d: rounded(mask.nearest_mask(td.grid_cells(s, d), td.mask_points(s, d)).select("cell_id", "land_frac")),
    "polygon_weights": lambda s, d: rounded(spatial.build_admin_weights(td.grid_cells(s, d), td.unit_boxes(s, d), half_width=1.5)),
    "bbox_margin": lambda s, d: rounded(spatial.bbox_with_margin(td.grid_cells(s, d))),
    "label_dates": _label_dates,
    "index_national_month": lambda s, d: rounded(national(s, d, "month")),
    "index_national_season": lambda s, d: rounded(national(s, d, "season")),
    "index_national_semester": lambda s, d: rounded(national(s, d, "semester")),
    "index_national_year": lambda s, d: rounded(national(s, d, "year")),
    "index_grid_season": lambda s, d: rounded(grid(s, d)),
    "index_admin_year": lambda s, d: rounded(admin(s, d)),
    "plot_timeseries": lambda s, d: rounded(plots.timeseries(national(s, d, "season"))),
    "plot_components": lambda s, d: rounded(plots.components(national(s, d, "year"))),
    "plot_distribution": lambda s, d: rounded(plots.distribution(national(s, d, "month"))),
    "map_mean": lambda s, d: rounded(plots.map_mean(grid(s, d), "aci", start="1996", end="2000", cells=td.grid_cells(s, d))),
    "map_animation": lambda s, d: rounded(plots.animation(grid(s, d, "year"), "t90", cells=td.grid_cells(s, d))),
}

# --- DuckDB -----------------------------------------------------------------------------

_REF_D = f"BETWEEN DATE '{REF[0]}' AND DATE '{REF[1]}'"
_REF_T = f"BETWEEN TIMESTAMP '{REF[0]} 00:00:00' AND TIMESTAMP '{REF[1]} 00:00:00'"
_LABEL = {
    "month": "strftime(month, '%Y-%m')",
    "year": "CAST(year(month) AS VARCHAR)",
    "semester": "year(month) || CASE WHEN month(month) <= 6 THEN '-S1' ELSE '-S2' END",
    "season": "(year(month) + CASE WHEN month(month) = 12 THEN 1 ELSE 0 END) || CASE WHEN month(month) IN (12, 1, 2) THEN '-DJF' WHEN month(month) <= 5 THEN '-MAM' WHEN month(month) <= 8 THEN '-JJA' ELSE '-SON' END",
}


def _z(source: str, by: str) -> str:
    """Reference statistics by calendar month, joined back."""
    keys = "cell_id, " if by == "cell" else ""
    on = "r.moy = month(x.month)" + (" AND r.cell_id = x.cell_id" if by == "cell" else "")
    select = "x.cell_id, " if by == "cell" else ""
    return (
        f"SELECT {select}x.month, (x.value - r.m) / CASE WHEN r.s IS NULL OR r.s < 2.220446049250313e-16 THEN 1 ELSE r.s END AS value "
        f"FROM {source} x LEFT JOIN (SELECT {keys}month(month) AS moy, avg(value) AS m, stddev_samp(value) AS s FROM {source} WHERE month {_REF_D} AND value IS NOT NULL GROUP BY ALL) r ON {on}"
    )


def _area(source: str) -> str:
    return f"SELECT month, avg(value) AS value FROM {source} GROUP BY month"


def _thresholds(part: str, p: float) -> str:
    left, right = (39, 40) if part == "day" else (19, 20)
    hours = "hour(ts) BETWEEN 6 AND 21" if part == "day" else "NOT hour(ts) BETWEEN 6 AND 21"
    w = f"(PARTITION BY cell_id ORDER BY ts ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    return (
        f"SELECT cell_id, CAST(dayofyear(ts) AS INTEGER) AS doy, quantile_cont(q, {p}) AS thr FROM (SELECT cell_id, ts, CASE WHEN count(*) OVER {w} = {left + right + 1} THEN quantile_cont(t2m, {p}) OVER {w} END AS q "
        f"FROM hourly WHERE {hours} AND ts {_REF_T}) GROUP BY 1, 2"
    )


def _halfday(part: str, extremum: str, thr: str, sign: str) -> str:
    hours = "hour(ts) BETWEEN 6 AND 21" if part == "day" else "NOT hour(ts) BETWEEN 6 AND 21"
    return (
        f"SELECT d.cell_id, CAST(date_trunc('month', d.day) AS DATE) AS month, sum(CASE WHEN d.v {sign} t.thr THEN 1 WHEN d.v IS NULL OR t.thr IS NULL THEN NULL ELSE 0 END) / count(*) AS value "
        f"FROM (SELECT cell_id, CAST(ts AS DATE) AS day, {extremum}(t2m) AS v FROM hourly WHERE {hours} GROUP BY 1, 2) d LEFT JOIN {thr} t ON t.cell_id = d.cell_id AND t.doy = dayofyear(d.day) GROUP BY 1, 2"
    )


_CTES: dict[str, str] = {
    "hourly": "SELECT CAST(n_regionkey AS INTEGER) AS cell_id, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST((l_orderkey * 7 + l_linenumber * 3) % 24 AS INTEGER)) AS ts, avg(CAST(l_quantity AS DOUBLE)) + 263.15 AS t2m, "
    "sum(CASE WHEN l_quantity > 25 THEN CAST(l_extendedprice AS DOUBLE) / 1e8 ELSE 0 END) AS tp, avg(CAST(l_discount AS DOUBLE) * 100) AS u10, avg(CAST(l_tax AS DOUBLE) * 100) AS v10 "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "cells": "SELECT CAST(r_regionkey AS INTEGER) AS cell_id, r_regionkey * 3.0 - 6 AS lon, 42 + r_regionkey * 2.0 AS lat, f AS land_frac FROM region LEFT JOIN (SELECT n_regionkey, avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON r_regionkey = n_regionkey",
    "weights": "SELECT CAST(n_regionkey AS INTEGER) AS cell_id, 'U' || (n_nationkey % 3) AS unit, count(*) / 5.0 AS w FROM nation GROUP BY 1, 2",
    "alpha": "SELECT * FROM (VALUES ('U0', 0.6::DOUBLE), ('U1', 0.3::DOUBLE), ('U2', 0.0::DOUBLE)) t(unit, alpha)",
    "unit_stations": "SELECT 'U' || (n_nationkey % 3) AS unit, CAST(n_nationkey AS INTEGER) AS station_id FROM nation WHERE n_nationkey % 3 < 2",
    "stations": "SELECT CAST(n_nationkey AS INTEGER) AS station_id, CAST(40.0 + (n_nationkey * 7) % 13 AS DOUBLE) AS lat, CAST(-6 + n_nationkey * 0.9 AS DOUBLE) AS lon FROM nation",
    "obs": "SELECT station_id, month, CASE WHEN (year(month) * 12 + month(month) + station_id) % 29 = 0 THEN NULL ELSE level END AS level FROM (SELECT CAST(c_nationkey AS INTEGER) AS station_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(CAST(o_totalprice AS DOUBLE)) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "gauge_stats": f"SELECT CAST(month(month) AS INTEGER) AS moy, avg(l) AS mean, CASE WHEN stddev_samp(l) IS NULL OR stddev_samp(l) < 2.220446049250313e-16 THEN 1 ELSE stddev_samp(l) END AS sd FROM (SELECT month, avg(level) AS l FROM obs WHERE month {_REF_D} GROUP BY month) GROUP BY 1",
    "anomalies": f"SELECT station_id, month, (level - mean) / sd AS value FROM obs JOIN gauge_stats ON moy = month(month) WHERE month BETWEEN DATE '{STUDY[0]}' AND DATE '{STUDY[1]}' AND level IS NOT NULL",
    "daily_rain": "SELECT cell_id, CAST(ts AS DATE) AS day, sum(tp) AS value FROM hourly GROUP BY 1, 2",
    "rolled": "SELECT cell_id, day, CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END AS value FROM daily_rain WINDOW w AS (PARTITION BY cell_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "rain": "SELECT cell_id, CAST(date_trunc('month', day) AS DATE) AS month, max(value) AS value FROM rolled GROUP BY 1, 2",
    "cdd": "SELECT cell_id, CAST(year(day) AS INTEGER) AS year, CAST(max(streak) AS DOUBLE) AS cdd FROM (SELECT cell_id, day, CASE WHEN dry IS NOT NULL THEN coalesce(sum(dry) OVER (PARTITION BY cell_id, run ORDER BY day), 0) END AS streak FROM (SELECT *, sum(CASE WHEN dry = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY day) AS run FROM (SELECT cell_id, day, CASE WHEN value < 0.001 THEN 1 WHEN value IS NOT NULL THEN 0 END AS dry FROM daily_rain))) GROUP BY 1, 2",
    "dry": "SELECT cell_id, make_date(year, CAST(m AS INTEGER), 1) AS month, (12 - m) / 12.0 * cdd + m / 12.0 * nxt AS value FROM (SELECT *, CASE WHEN lead(year) OVER (PARTITION BY cell_id ORDER BY year) IS NULL THEN cdd ELSE lead(cdd) OVER (PARTITION BY cell_id ORDER BY year) END AS nxt FROM cdd), (SELECT unnest(range(1, 13)) AS m)",
    "wp": "SELECT cell_id, day, 0.5 * 1.23 * pow(sqrt(u * u + v * v), 3) AS wp FROM (SELECT cell_id, CAST(ts AS DATE) AS day, avg(u10) AS u, avg(v10) AS v FROM hourly GROUP BY 1, 2)",
    "wind_thr": f"SELECT w.*, r.thr FROM wp w LEFT JOIN (SELECT cell_id, dayofyear(day) AS doy, avg(wp) + 1.28 * stddev_samp(wp) AS thr FROM wp WHERE day {_REF_D} GROUP BY 1, 2) r ON r.cell_id = w.cell_id AND r.doy = dayofyear(w.day)",
    "wind_flags": "SELECT cell_id, day, CAST(CASE WHEN wp > thr THEN 1 WHEN thr IS NOT NULL AND wp IS NOT NULL THEN 0 END AS INTEGER) AS flag FROM wind_thr",
    "wind": "SELECT cell_id, CAST(date_trunc('month', day) AS DATE) AS month, sum(flag) / count(*) AS value FROM wind_flags GROUP BY 1, 2",
    "day90": _thresholds("day", 0.9),
    "night90": _thresholds("night", 0.9),
    "day10": _thresholds("day", 0.1),
    "night10": _thresholds("night", 0.1),
    "hot_day": _halfday("day", "max", "day90", ">"),
    "hot_night": _halfday("night", "max", "night90", ">"),
    "cold_day": _halfday("day", "min", "day10", "<"),
    "cold_night": _halfday("night", "min", "night10", "<"),
    "hot": "SELECT d.cell_id, d.month, 0.5 * (d.value + n.value) AS value FROM hot_day d JOIN hot_night n USING (cell_id, month)",
    "cold": "SELECT d.cell_id, d.month, 0.5 * (d.value + n.value) AS value FROM cold_day d JOIN cold_night n USING (cell_id, month)",
    **{f"{x}_z": _z(x, "cell") for x in ("hot", "cold", "rain", "dry", "wind")},
    **{f"{x}_area": _area(x) for x in ("hot", "cold", "rain", "dry", "wind")},
    **{f"{x}_national": _z(f"{x}_area", "none") for x in ("hot", "cold", "rain", "dry", "wind")},
    "sea_region": "SELECT month, avg(value) AS sealevel FROM anomalies GROUP BY month",
    "national": "SELECT h.month, h.value AS t90, c.value AS t10, r.value AS precipitation, d.value AS drought, w.value AS wind, s.sealevel, (h.value - c.value + r.value + d.value + w.value + 0.2 * s.sealevel) / 5.2 AS aci FROM hot_national h JOIN cold_national c USING (month) JOIN rain_national r USING (month) JOIN dry_national d USING (month) JOIN wind_national w USING (month) JOIN sea_region s USING (month)",
    "dist": "SELECT cell_id, station_id, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS d FROM cells c, stations s",
    "sea_grid": "SELECT c.cell_id, m.month, v.value FROM cells c CROSS JOIN (SELECT DISTINCT month FROM anomalies) m LEFT JOIN (SELECT cell_id, month, sum(value / pow(greatest(d, 0.001), 2)) / sum(1 / pow(greatest(d, 0.001), 2)) AS value FROM dist JOIN anomalies USING (station_id) WHERE d <= {reach} GROUP BY 1, 2) v ON v.cell_id = c.cell_id AND v.month = m.month",
    "kept": f"SELECT cell_id FROM cells WHERE land_frac >= {td.THRESHOLD}",
    "sea_units": "SELECT a.unit, m.month, v.sealevel FROM alpha a CROSS JOIN (SELECT DISTINCT month FROM anomalies) m LEFT JOIN (SELECT unit, month, avg(value) AS sealevel FROM anomalies JOIN unit_stations USING (station_id) GROUP BY 1, 2) v ON v.unit = a.unit AND v.month = m.month",
    **{f"{x}_unit": f"SELECT unit, month, sum(CASE WHEN w <> 0 THEN w * value END) / sum(CASE WHEN w <> 0 AND value IS NOT NULL THEN w END) AS value FROM {x}_z JOIN weights USING (cell_id) GROUP BY 1, 2" for x in ("hot", "cold", "rain", "dry", "wind")},
    "admin": "SELECT h.unit, h.month, h.value AS t90, c.value AS t10, r.value AS precipitation, d.value AS drought, w.value AS wind, s.sealevel, (h.value - c.value + r.value + d.value + w.value + CASE WHEN alpha = 0 THEN 0 ELSE alpha * s.sealevel END) / (5 + alpha) AS aci FROM hot_unit h LEFT JOIN cold_unit c USING (unit, month) LEFT JOIN rain_unit r USING (unit, month) LEFT JOIN dry_unit d USING (unit, month) LEFT JOIN wind_unit w USING (unit, month) LEFT JOIN sea_units s USING (unit, month) JOIN alpha USING (unit)",
    # Masked cells have a row per month of the component, all NULL.
    **{f"{x}_g": f"SELECT c.cell_id, m.month, z.value FROM cells c CROSS JOIN (SELECT DISTINCT month FROM {x}_z WHERE cell_id IN (SELECT cell_id FROM kept)) m LEFT JOIN (SELECT * FROM {x}_z WHERE cell_id IN (SELECT cell_id FROM kept)) z ON z.cell_id = c.cell_id AND z.month = m.month" for x in ("hot", "cold", "rain", "dry", "wind")},
    "sea_first": "SELECT cell_id, arg_min(CASE WHEN value IS NULL THEN 0 ELSE 1 END, month) AS a FROM sea_grid GROUP BY 1",
    "grid": "SELECT h.cell_id, h.month, h.value AS t90, c.value AS t10, r.value AS precipitation, d.value AS drought, w.value AS wind, s.value AS sealevel, (h.value - c.value + r.value + d.value + w.value + a * coalesce(s.value, 0)) / (5 + a) AS aci FROM hot_g h LEFT JOIN cold_g c USING (cell_id, month) LEFT JOIN rain_g r USING (cell_id, month) LEFT JOIN dry_g d USING (cell_id, month) LEFT JOIN wind_g w USING (cell_id, month) LEFT JOIN sea_grid s USING (cell_id, month) JOIN sea_first f ON f.cell_id = h.cell_id",
}
_VALUES = ("t90", "t10", "precipitation", "drought", "wind", "sealevel", "aci")


def _sql(final: str, *, reach: int = 500) -> str:
    """``final`` after the tables it needs, directly or not."""
    import re

    need: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)\b", sql):
            if name in _CTES and name not in seen:
                seen.add(name)
                visit(_CTES[name])
                need.append(name)

    visit(final)
    tables = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n].replace('{reach}', str(reach))})" for n in need)
    return f"WITH {tables}\n{final}" if need else final


def _r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def _periods(source: str, granularity: str, keys: str = "") -> str:
    return f"SELECT {keys}{_LABEL[granularity]} AS period, " + ", ".join(_r(f"avg({v})", v) for v in _VALUES) + f" FROM {source} GROUP BY ALL"


_TIMESERIES = _periods("national", "season")
ORACLE_SQL: dict[str, str] = {
    **{f"resample_daily_{k}": _sql(f"SELECT cell_id, CAST(ts AS DATE) AS day, {_r(f'{f}(tp)', 'value', 14)} FROM hourly GROUP BY 1, 2") for k, f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"))},
    "resample_monthly_mean": _sql(f"SELECT cell_id, CAST(date_trunc('month', day) AS DATE) AS month, {_r('avg(v)', 'value')} FROM (SELECT cell_id, CAST(ts AS DATE) AS day, avg(t2m) AS v FROM hourly GROUP BY 1, 2) GROUP BY 1, 2"),
    **{
        f"temp_extremum_{p}_{e}": _sql(f"SELECT cell_id, CAST(ts AS DATE) AS day, {_r(f'{e}(t2m)', 'value')} FROM hourly WHERE {'' if p == 'day' else 'NOT '}hour(ts) BETWEEN 6 AND 21 GROUP BY 1, 2")
        for p in ("day", "night")
        for e in ("min", "max")
    },
    "rolling_sum_5d": _sql(f"SELECT cell_id, day, {_r('value', None, 10)} FROM rolled"),
    "precip_max_5d": _sql(f"SELECT cell_id, month, {_r('value', None, 10)} FROM rain"),
    **{f"temp_percentiles_{p}": _sql(f"SELECT cell_id, doy, {_r('thr')} FROM {p}90") for p in ("day", "night")},
    "temp_percentiles_kernel": _sql(f"SELECT cell_id, doy, {_r('thr')} FROM night90"),
    "temp_percentiles_native": _sql(f"SELECT cell_id, doy, {_r('thr')} FROM night10"),
    "halfday_frequency_hot": _sql(f"SELECT cell_id, month, {_r('value')} FROM hot_day"),
    "halfday_frequency_cold": _sql(f"SELECT cell_id, month, {_r('value')} FROM cold_night"),
    "temperature_t90": _sql(f"SELECT cell_id, month, {_r('value', 't90')} FROM hot_z"),
    "temperature_t10": _sql(f"SELECT cell_id, month, {_r('value', 't10')} FROM cold_z"),
    "wind_power": _sql(f"SELECT cell_id, day, {_r('wp')} FROM wp"),
    "wind_thresholds": _sql(f"SELECT cell_id, day, {_r('wp')}, {_r('thr')} FROM wind_thr"),
    "wind_days_above": _sql("SELECT cell_id, day, CAST(flag AS DOUBLE) AS flag FROM wind_flags"),
    "wind_frequency": _sql(f"SELECT cell_id, month, {_r('value')} FROM wind"),
    "cdd_annual": _sql(f"SELECT cell_id, year, {_r('cdd')} FROM cdd"),
    "drought_monthly": _sql(f"SELECT cell_id, month, {_r('value')} FROM dry"),
    "standardize_grid": _sql(f"SELECT cell_id, month, {_r('value')} FROM rain_z"),
    "standardize_area": _sql(f"SELECT month, {_r('value')} FROM rain_national"),
    "national_mean": _sql(f"SELECT month, {_r('value', None, 10)} FROM rain_area"),
    "granularity_season": _sql(f"SELECT cell_id, {_LABEL['season']} AS period, {_r('avg(value)', 'value')} FROM rain_z GROUP BY ALL"),
    "admin_weighted_mean": _sql(f"SELECT unit, month, {_r('value')} FROM rain_unit"),
    "mask_cells": _sql(f"SELECT cell_id, day, {_r(f'CASE WHEN land_frac >= {td.THRESHOLD} THEN v END', 'value')} FROM (SELECT cell_id, CAST(ts AS DATE) AS day, avg(t2m) AS v FROM hourly GROUP BY 1, 2) LEFT JOIN cells USING (cell_id)"),
    "mask_drop_and_rejoin": _sql(f"SELECT c.cell_id, m.month, {_r('x.value', 'value', 10)} FROM cells c CROSS JOIN (SELECT DISTINCT month FROM rain WHERE cell_id IN (SELECT cell_id FROM kept)) m LEFT JOIN (SELECT * FROM rain WHERE cell_id IN (SELECT cell_id FROM kept)) x ON x.cell_id = c.cell_id AND x.month = m.month"),
    **{
        name: _sql(f"SELECT n_steps, start, \"end\", (epoch(second) - epoch(start)) / 3600.0 AS step_hours FROM (SELECT count(*) AS n_steps, min(ts) AS start, max(ts) AS \"end\", list_sort(list(ts))[2] AS second FROM (SELECT DISTINCT {ts} AS ts FROM hourly))")
        for name, ts in (("time_resolution", "ts"), ("time_resolution_daily", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
    },
    "daily_table": _sql(
        "SELECT cell_id, CAST(ts AS DATE) AS day, "
        + ", ".join(f"count(*) FILTER ({c}) AS {p}_n, {_r(f'max(t2m) FILTER ({c})', p + '_max', 10)}, {_r(f'min(t2m) FILTER ({c})', p + '_min', 10)}" for p, c in (("day", "hour(ts) BETWEEN 6 AND 21"), ("night", "hour(ts) NOT BETWEEN 6 AND 21")))
        + f", {_r('sum(tp)', 'tp', 10)}, {_r('avg(u10)', 'u', 10)}, {_r('avg(v10)', 'v', 10)} FROM hourly GROUP BY ALL"
    ),
    "plot_density": _sql(
        "SELECT component, "
        + f"{_r('x')}, {_r('sum(exp(-0.5 * pow((x - wind) / h, 2)) / (n * h * sqrt(2 * pi())))', 'density')} FROM (SELECT 'wind' AS component, wind, n, h, k, low + (high - low) * k / 15 AS x FROM national, (SELECT count(wind) AS n, min(wind) AS low, max(wind) AS high, 0.9 * least(stddev_samp(wind), (quantile_cont(wind, 0.75) - quantile_cont(wind, 0.25)) / 1.34) * pow(count(wind), -0.2) AS h FROM national), (SELECT unnest(range(16)) AS k) WHERE wind IS NOT NULL) GROUP BY component, k, x"
    ),
    "union_along_time": _sql("SELECT cell_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM hourly GROUP BY 1, 2"),
    "gauge_dates": "SELECT CAST(n_nationkey AS INTEGER) AS station_id, t AS text, make_date(CAST(substr(t, 1, 4) AS INTEGER), m, 1) AS month FROM (SELECT n_nationkey, '20' || lpad(CAST((n_nationkey % 12) * 3 AS VARCHAR), 2, '0') || ['.0417', '.1250', '.2083', '', '.5', '.9583', '.875'][n_nationkey % 7 + 1] AS t, [1, 2, 3, 1, NULL, 12, 11][n_nationkey % 7 + 1] AS m FROM nation)",
    "sealevel_clean": _sql(f"SELECT station_id, month, {_r('level', None, 8)} FROM obs"),
    "gauge_files": _sql(f"SELECT station_id, month, {_r('level', None, 8)} FROM obs"),
    "precipitation_saved": _sql(f"SELECT cell_id, month, {_r('value', 'precipitation')} FROM rain_z"),
    "sealevel_saved": _sql(f"SELECT month, {_r('sealevel')} FROM sea_region"),
    "stream_daily": _sql(f"SELECT cell_id, CAST(ts AS DATE) AS day, {_r('avg(t2m)', 't2m')} FROM hourly WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) FROM hourly) GROUP BY 1, 2"),
    "sealevel_monthly_stats": _sql(f"SELECT moy, {_r('mean', None, 4)}, {_r('sd', None, 4)} FROM gauge_stats"),
    "sealevel_standardize": _sql(f"SELECT station_id, month, {_r('value')} FROM anomalies"),
    "sealevel_region": _sql(f"SELECT month, {_r('sealevel')} FROM sea_region"),
    "sealevel_units": _sql(f"SELECT unit, month, {_r('sealevel')} FROM sea_units"),
    "idw_sealevel": _sql(f"SELECT cell_id, month, {_r('value')} FROM sea_grid"),
    "idw_sealevel_150km": _sql(f"SELECT cell_id, month, {_r('value')} FROM sea_grid", reach=150),
    "nearest_unit": _sql("SELECT station_id, arg_min('C' || cell_id, d) AS unit FROM dist GROUP BY 1"),
    "nearest_mask": _sql(
        f"SELECT cell_id, {_r('f', 'land_frac')} FROM (SELECT cell_id, station_id / 24.0 AS f, row_number() OVER (PARTITION BY cell_id ORDER BY pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2), s.lon, s.lat) AS n FROM cells c CROSS JOIN stations s) WHERE n = 1"
    ),
    "polygon_weights": _sql(
        f"SELECT cell_id, unit, {_r('least(sum(w), 1.0)', 'w')} FROM (SELECT cell_id, 'U' || (station_id % 3) AS unit, greatest(least(c.lon, s.lon) + 1.5 - (greatest(c.lon, s.lon) - 1.5), 0) * greatest(least(c.lat + 1.5, s.lat + 1) - greatest(c.lat - 1.5, s.lat - 1), 0) / 9.0 AS w FROM cells c CROSS JOIN stations s) WHERE w > 0 GROUP BY ALL"
    ),
    "bbox_margin": _sql(f"SELECT {_r('min(lon) - 0.05 * (max(lon) - min(lon))', 'lon_min')}, {_r('max(lon) + 0.05 * (max(lon) - min(lon))', 'lon_max')}, {_r('min(lat) - 0.05 * (max(lat) - min(lat))', 'lat_min')}, {_r('max(lat) + 0.05 * (max(lat) - min(lat))', 'lat_max')} FROM cells"),
    "label_dates": _sql(
        "SELECT DISTINCT granularity, period, date FROM (SELECT unnest([{'granularity': 'month', 'period': "
        + _LABEL["month"]
        + ", 'date': month}, {'granularity': 'season', 'period': "
        + _LABEL["season"]
        + ", 'date': CASE WHEN month(month) = 12 THEN make_date(year(month) + 1, 1, 1) WHEN month(month) <= 2 THEN make_date(year(month), 1, 1) ELSE make_date(year(month), month(month) // 3 * 3, 1) END}, {'granularity': 'semester', 'period': "
        + _LABEL["semester"]
        + ", 'date': make_date(year(month), CASE WHEN month(month) <= 6 THEN 1 ELSE 7 END, 1)}, {'granularity': 'year', 'period': "
        + _LABEL["year"]
        + ", 'date': make_date(year(month), 1, 1)}], recursive := true) FROM (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month FROM hourly))"
    ),
    **{f"index_national_{g}": _sql(_periods("national", g)) for g in ("month", "season", "semester", "year")},
    "index_grid_season": _sql(_periods("grid", "season", "cell_id, ")),
    "index_admin_year": _sql(_periods("admin", "year", "unit, ")),
    "plot_timeseries": _sql(
        f"SELECT make_date(CAST(period[1:4] AS INTEGER), CASE period[6:8] WHEN 'DJF' THEN 1 WHEN 'MAM' THEN 3 WHEN 'JJA' THEN 6 ELSE 9 END, 1) AS date, aci, CASE WHEN aci IS NOT NULL THEN least(aci, 0.0) END AS ribbon_min, CASE WHEN aci IS NOT NULL THEN greatest(aci, 0.0) END AS ribbon_max, 'Seasonal' AS granularity FROM ({_TIMESERIES})"
    ),
    "plot_components": _sql(
        f"SELECT make_date(CAST(period AS INTEGER), 1, 1) AS date, component, value FROM ({_periods('national', 'year')}) UNPIVOT INCLUDE NULLS (value FOR component IN (t90, t10, precipitation, drought, wind, sealevel))"
    ),
    "plot_distribution": _sql(
        f"SELECT component, count(value) AS n, {_r('min(value)', 'low')}, {_r('quantile_cont(value, 0.25)', 'q25')}, {_r('quantile_cont(value, 0.5)', 'q50')}, {_r('quantile_cont(value, 0.75)', 'q75')}, {_r('max(value)', 'high')} FROM (SELECT month, {', '.join(_VALUES)} FROM national) UNPIVOT INCLUDE NULLS (value FOR component IN ({', '.join(_VALUES)})) GROUP BY 1"
    ),
    "map_mean": _sql(
        f"SELECT cell_id, lon, lat, {_r('value')} FROM (SELECT cell_id, avg(aci) AS value FROM (SELECT cell_id, {_LABEL['season']} AS period, avg(aci) AS aci FROM grid GROUP BY ALL) WHERE period >= '1996' AND period <= '2000' GROUP BY 1) JOIN cells USING (cell_id) WHERE value IS NOT NULL"
    ),
    "map_animation": _sql(f"SELECT cell_id, period, {_r('value')}, lon, lat FROM (SELECT cell_id, {_LABEL['year']} AS period, avg(t90) AS value FROM grid GROUP BY ALL) JOIN cells USING (cell_id) WHERE value IS NOT NULL"),
}
