"""Composite index, sources, plots, streaming, and the registered queries against DuckDB."""

import glob
import os
import re
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from climadex.operators import frequency, resample
from climadex.plans import components, index, plots
from climadex.plans import queries as climate
from climadex.sources import cache, gauges, netcdf3
from climadex.streaming import daily

DATA = "/root/testdata/sf0.001"
MONTH = date(2000, 1, 1)


def part(spark, name, values, months=(MONTH,)):
    rows = [(c, m, None if v is None else float(v)) for m in months for c, v in enumerate(values)]
    return spark.createDataFrame(rows, f"cell_id int, month date, {name} double")


def zero_parts(spark, n=2, months=(MONTH,)):
    return [part(spark, x, [0] * n, months) for x in ("precipitation", "drought", "wind")]


def by_cell(df):
    return [(r["aci"], r["sealevel"]) for r in df.orderBy("month", "cell_id").collect()]


def test_grid_with_and_without_sea(spark):
    high, low = part(spark, "t90", [10, 20]), part(spark, "t10", [2, 2])
    assert by_cell(index.combine_grid(high, low, *zero_parts(spark), part(spark, "sealevel", [5, None]))) == [(pytest.approx(13 / 6), 5), (pytest.approx(18 / 5), None)]
    assert by_cell(index.combine_grid(high, low, *zero_parts(spark))) == [(1.6, 0), (3.6, 0)]
    other = index.combine_grid(part(spark, "t95", [15]), part(spark, "t5", [5]), *zero_parts(spark, 1), high_col="t95", low_col="t5")
    assert "t90" not in other.columns and by_cell(other)[0][0] == 2


def test_grid_alpha_is_frozen_at_the_first_month(spark):
    months = (MONTH, date(2000, 2, 1))
    high, low = part(spark, "t90", [10, 10], months), part(spark, "t10", [2, 2], months)
    sea = part(spark, "sealevel", [4, None]).unionByName(part(spark, "sealevel", [None, 6], months[1:]))
    got = by_cell(index.combine_grid(high, low, *zero_parts(spark, 2, months), sea))
    assert [x[0] for x in got] == pytest.approx([12 / 6, 8 / 5, 8 / 6, 8 / 5])
    none = part(spark, "sealevel", [None, None], months)
    assert [x[0] for x in by_cell(index.combine_grid(high, low, *zero_parts(spark, 2, months), none))] == pytest.approx([1.6] * 4)


def test_national(spark):
    def s(name, v):
        return spark.createDataFrame([(MONTH, float(v))], f"month date, {name} double")

    got = index.combine_national(s("t90", 1), s("t10", 0), s("precipitation", 1), s("drought", 1), s("wind", 1), s("sealevel", 1))
    assert got.first()["aci"] == pytest.approx((1 - 0 + 1 + 1 + 0.2 + 1) / 5.2)


def test_units(spark):
    def u(name, values):
        return spark.createDataFrame([(n, MONTH, None if v is None else float(v)) for n, v in values.items()], f"unit string, month date, {name} double")

    parts = [u("t90", {"A": 10, "B": 10, "C": 10}), u("t10", {"A": 2, "B": 2, "C": 2}), *[u(x, {"A": 0, "B": 0, "C": 0}) for x in ("precipitation", "drought", "wind")]]
    sea = u("sealevel", {"A": 5, "B": None, "C": None})
    alpha = spark.createDataFrame([("A", 0.5), ("B", 0.0), ("C", 0.4)], "unit string, alpha double")
    got = {r["unit"]: r["aci"] for r in index.combine_admin(*parts, sea, alpha).collect()}
    assert got == {"A": pytest.approx(10.5 / 5.5), "B": pytest.approx(1.6), "C": None}
    loose = {r["unit"]: r["aci"] for r in index.combine_admin(*parts, sea, alpha, strict=False).collect()}
    assert loose["C"] == pytest.approx(1.6)


def test_engine_names(spark):
    with pytest.raises(ValueError, match="engine"):
        index.calculate_index(None, None, reference=("a", "b"), study=("a", "b"), engine="fast")
    components.check_engine("terra")


def test_masked_component_has_one_null_cell(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(c, datetime(2001, 1, 1) + timedelta(days=d), float(rng.exponential(0.002))) for c in range(4) for d in range(730)]
    cube = spark.createDataFrame(rows, "cell_id int, ts timestamp_ntz, tp double")
    cells = spark.createDataFrame([(c, float(c != 2)) for c in range(4)], "cell_id int, land_frac double")
    ref = ("2001-01-01", "2001-12-31")
    saved = components.Saved(str(tmp_path), ("2001-01-01", "2002-12-31"))
    got = components.precipitation_component(cube, reference=ref, cells=cells, saved=saved)
    nulls = {r["cell_id"]: r["n"] for r in got.groupBy("cell_id").agg(F.count_if(F.col("precipitation").isNull()).alias("n")).collect()}
    assert nulls == {0: 0, 1: 0, 2: 24, 3: 0}
    # The mask commutes with the reductions.
    plain = components.precipitation_component(cube, reference=ref)
    assert sorted(got.where("cell_id <> 2").collect()) == sorted(plain.where("cell_id <> 2").collect())
    again = components.precipitation_component(cube.where("false"), reference=ref, cells=cells, saved=components.Saved(str(tmp_path), ("2001-01-01", "2002-12-31"), computed=True))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    with pytest.raises(FileNotFoundError):
        components.drought_component(cube, reference=ref, saved=components.Saved(str(tmp_path), ("2001-01-01", "2002-12-31"), computed=True))
    weights = spark.createDataFrame([(0, "A", 1.0), (1, "A", 1.0), (3, "B", 1.0)], "cell_id int, unit string, w double")
    units = components.drought_component(cube, reference=ref, weights=weights)
    assert {r["unit"] for r in units.select("unit").distinct().collect()} == {"A", "B"} and units.count() == 48


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(6)
    rows = [(c, datetime(2001, 1, 1) + timedelta(hours=6 * h), float(rng.normal())) for c in range(6) for h in range(4 * 400)]
    cube = spark.createDataFrame(rows, "cell_id int, ts timestamp_ntz, t2m double")
    how = {"reference": ("2001-01-01", "2001-12-31"), "part": "night", "extremum": "max", "percentile": 90, "above": True}
    a = frequency.halfday_frequency(cube.repartition(1), **how).collect()
    b = frequency.halfday_frequency(cube.orderBy(F.rand(3)).repartition(7), **how, kernel="pandas").collect()
    assert sorted(a) == sorted(b)


def test_wind_chain_shuffles_once(spark):
    cube = spark.createDataFrame([(0, datetime(2001, 1, 1), 1.0, 1.0)], "cell_id int, ts timestamp_ntz, u10 double, v10 double").repartition(4, "cell_id")
    plan = frequency.wind_exceedance_frequency(cube, reference=("2001-01-01", "2001-12-31"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("cell_id"), F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("t2m"), F.lit(2.0).alias("tp")).write.parquet(str(tmp_path / "c"))
    cube = spark.read.parquet(str(tmp_path / "c"))
    plan = resample.resample_daily(cube.where("ts >= timestamp_ntz'2000-01-01'"), "tp", "sum")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "t2m" not in plan[plan.index("ReadSchema") :]


def test_netcdf_round_trip(spark, tmp_path):
    lon, lat, hours = [-1.0, 0.0], [45.0, 44.0, 43.0], [0, 1, 24]
    values = np.arange(18, dtype=float).reshape(3, 3, 2)
    values[1, 0, 1] = np.nan
    a, b, m = (str(tmp_path / x) for x in ("a.nc", "b.nc", "m.nc"))
    netcdf3.write_netcdf3(a, lon, lat, values, variable="t2m", hours=hours)
    netcdf3.write_netcdf3(b, lon, lat, values + 100, variable="t2m", hours=[48, 49, 50])
    netcdf3.write_netcdf3(m, lon, lat, np.array([[1, 1], [1, 0.5], [1, 1]]), variable="country")
    got = netcdf3.load_cube(spark, [a, b], "t2m").collect()
    assert len(got) == 36
    at = {(r["lon"], r["lat"], r["ts"]): (r["cell_id"], r["t2m"]) for r in got}
    assert at[-1.0, 45.0, datetime(1900, 1, 1)] == (2, 0.0) and at[0.0, 43.0, datetime(1900, 1, 3, 2)] == (3, 117.0)
    assert at[0.0, 45.0, datetime(1900, 1, 1, 1)][1] is None
    masked = netcdf3.load_component(spark, a, "t2m", mask_path=m)
    assert {r["cell_id"] for r in masked.where("t2m is null").collect()} == {4, 5}
    times = netcdf3.describe_times(netcdf3.load_cube(spark, b, "t2m")).first()
    assert (times["n_steps"], times["step_hours"]) == (3, 1.0)
    with pytest.raises(Exception, match="no variable"):
        netcdf3.load_cube(spark, a, "tp").count()
    with pytest.raises(ValueError):
        netcdf3.decode_times(np.array([1.0]), "minutes since 2000-01-01")
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="NetCDF-4"):
        netcdf3.load_cube(spark, str(tmp_path / "x.nc"), "t2m").count()


def test_gauge_files(spark, tmp_path):
    (tmp_path / "1.txt").write_text(" 2011.0417;  7001;N;000\n 2011.1250;-99999;N;000\n 2011.5;1;N;000\n")
    (tmp_path / "61.txt").write_text("2011.0417;7100;N;000\n2011;7200\n")
    (tmp_path / "list.csv").write_text("Station Name,ID,Lat.,Lon.,Country\nBrest,1,48.38,-4.49,FRA\nX,61,50.0,1.0,GBR\n")
    got = sorted((r["station_id"], r["month"].month, r["level"]) for r in gauges.load_gauges(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 7001), (1, 2, -99999), (61, 1, 7100), (61, 1, 7200)]
    assert [r["station_id"] for r in gauges.load_stations(spark, str(tmp_path / "list.csv"), country="FRA").collect()] == [1]
    (tmp_path / "bad.csv").write_text("ID,Country\n1,FRA\n")
    with pytest.raises(ValueError, match="Lat"):
        gauges.load_stations(spark, str(tmp_path / "bad.csv"))
    assert cache.country_name(" fra ") == "France"
    with pytest.raises(ValueError):
        cache.country_name("XXX")
    assert cache.cube_paths("FRA", (2000, 2024), "d")["t2m"] == "d/FRA/t2m_2000_2024.nc"


def national_frame(spark):
    rows = [(f"20{y:02d}", 1.0 * y, 0.5, 0.1, None if y == 3 else 0.2, 0.3, 0.4, None if y == 3 else y - 5.0) for y in range(12)]
    return spark.createDataFrame(rows, "period string, t95 double, t5 double, precipitation double, drought double, wind double, sealevel double, aci double")


def test_plot_frames(spark):
    df = national_frame(spark)
    assert plots.temperature_columns(df) == ("t95", "t5")
    series = plots.timeseries(df).orderBy("date").collect()
    assert (series[0]["ribbon_min"], series[0]["ribbon_max"], series[3]["ribbon_max"], series[0]["granularity"]) == (-5, 0, None, "Annual")
    assert plots.components(df, components=["wind", "t95"]).count() == 24
    with pytest.raises(ValueError, match="unknown"):
        plots.components(df, components=["rain"])
    with pytest.raises(ValueError, match="no wind"):
        plots.components(df.drop("wind"))
    box = {r["component"]: r for r in plots.distribution(df).collect()}
    assert (box["t95"]["q50"], box["drought"]["n"], box["aci"]["n"]) == (5.5, 11, 11)
    smooth = plots.smoothed(df, span=0.8)
    assert smooth["trend"].notna().sum() == 11
    assert list(plots.dashboard(df)) == ["timeseries", "components", "distribution", "density"]
    x = np.linspace(0, 1, 30)
    assert plots.loess(x, 2 + 3 * x, 0.3) == pytest.approx(2 + 3 * x)


def test_maps(spark):
    grid = spark.createDataFrame([(c, f"20{y:02d}", None if c == 2 else float(c + y)) for c in range(3) for y in range(4)], "cell_id int, period string, aci double")
    assert {r["cell_id"]: r["value"] for r in plots.map_mean(grid, start="2001", end="2002").collect()} == {0: 1.5, 1: 2.5}
    assert plots.map_frame(grid, period="2003").count() == 2 and plots.animation(grid).count() == 8
    with pytest.raises(ValueError):
        plots.map_frame(grid, "t90")
    wide = index.wide_by_unit(grid.select(F.concat(F.lit("U"), "cell_id").alias("unit"), "period", "aci"), ["U0", "U1"], ["aci"])
    assert wide.columns == ["period", "aci_U0", "aci_U1"] and wide.count() == 4


def test_stream_of_hours_gives_the_batch_days(spark, tmp_path):
    rows = [(c, datetime(2001, 1, 1) + timedelta(hours=h), 1.0 * h, 0.0, 0.0, 0.0) for c in range(2) for h in range(24 * 6)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "cell_id int, ts timestamp, t2m double, tp double, u10 double, v10 double").repartition(3).write.parquet(str(src))
    out = daily.daily_stream(daily.read_hourly(spark, str(src)), "t2m", "max")
    daily.write_daily(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["cell_id"], r["day"]): r["t2m"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = resample.resample_daily(spark.read.parquet(str(src)), "t2m", "max").collect()
    closed = {(r["cell_id"], r["day"]): r["t2m"] for r in batch if r["day"] <= date(2001, 1, 4)}
    assert closed and closed.items() <= got.items()


def normal(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return ""
    return repr(float(x)) if isinstance(x, (int, float, np.number)) else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)


@pytest.mark.parametrize("name", sorted(n for n in climate.ORACLE_SQL if not n.startswith(("index_", "plot_", "map_", "temp_percentiles_day"))) + ["index_national_year", "plot_components"])
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(tuple(map(normal, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]


def test_entry_has_rows_or_a_schema(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "period" and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_steps_are_those_between_the_first_two_times(spark):
    def step(*times):
        return netcdf3.describe_times(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")).first()["step_hours"]

    first = datetime(2000, 1, 1)
    assert step(first, first + timedelta(days=1), first + timedelta(days=2), first) == 24
    assert step(datetime(2000, 1, 1, 23), datetime(2000, 1, 2, 2), datetime(2000, 1, 2, 3)) == 3
    assert step(first) is None


def test_the_index_reads_the_hours_twice(spark, tmp_path):
    """One scan for the daily table, one of the reference period for all thresholds."""
    from climadex.plans import testdata as td

    path = str(tmp_path / "hours")
    td.hourly(spark, DATA).write.parquet(path)
    hours = spark.read.parquet(path)
    spark.catalog.clearCache()
    out = index.calculate_index(hours, td.sealevel_obs(spark, DATA), reference=td.REFERENCE, study=td.STUDY, granularity="year")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    direct = plan.split("InMemoryRelation")[0].count("/hours") + sum(1 for leaf in _leaves(out) if leaf.startswith("Relation") and "t2m" in leaf)
    cached = {leaf for leaf in _leaves(out) if leaf.startswith("InMemoryRelation")}
    assert direct <= 2 and cached and all("day_max" in leaf for leaf in cached)
    native = index.calculate_index(hours, td.sealevel_obs(spark, DATA), reference=td.REFERENCE, study=td.STUDY, granularity="year", kernel="native")
    assert sorted(map(tuple, out.select("period", F.round("aci", 9)).collect())) == sorted(map(tuple, native.select("period", F.round("aci", 9)).collect()))
    spark.catalog.clearCache()


def _leaves(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [leaves.apply(i).toString().strip() for i in range(leaves.size())]


def test_gauges_without_files_and_units_without_gauges_are_errors(spark, tmp_path):
    from climadex.operators import mask

    with pytest.raises(FileNotFoundError):
        gauges.load_gauges(spark, str(tmp_path))
    units = spark.createDataFrame([("A", 0.0, 50.0), ("B", 10.0, 50.0), ("C", 20.0, 50.0)], "unit string, lon double, lat double")
    stations = spark.createDataFrame([(1, 1.0, 50.0), (2, 11.0, 51.0), (3, 9.0, 50.0)], "station_id int, lon double, lat double")
    coast = spark.createDataFrame([("A", 0.5), ("B", 1.0)], "unit string, alpha double")
    dealt, alpha = mask.assign_stations(stations, units, coast)
    assert sorted(map(tuple, dealt.collect())) == [("A", 1), ("B", 2), ("B", 3)]
    assert dict(map(tuple, alpha.collect())) == {"A": 0.5, "B": 1.0, "C": 0.0}
    with pytest.raises(ValueError, match="C"):
        mask.assign_stations(stations, units, spark.createDataFrame([("C", 0.1)], "unit string, alpha double"))


def test_density_sums_to_one(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{1990 + i // 12}-{i % 12 + 1:02d}", *map(float, rng.normal(size=7))) for i in range(60)]
    df = spark.createDataFrame(rows, "period string, t90 double, t10 double, precipitation double, drought double, wind double, sealevel double, aci double")
    got = plots.dashboard(df)["density"].toPandas()
    for _, part in got.groupby("component"):
        part = part.sort_values("x")
        assert len(part) == 64 and 0.8 < np.trapezoid(part["density"], part["x"]) <= 1.0
