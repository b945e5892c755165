"""Hand-computed values and traps of the climate operators."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from climadex.functions import dates, physics
from climadex.operators import drought, frequency, mask, resample, rolling, sealevel, spatial, standardize

HOUR = timedelta(hours=1)


def cube(spark, values, start=datetime(2001, 1, 1), step=HOUR, cell=0, name="v"):
    rows = [(cell, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"cell_id int, ts timestamp_ntz, {name} double")


def daily(spark, values, start=date(2001, 1, 1), cell=0):
    return spark.createDataFrame([(cell, start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "cell_id int, day date, value double")


def monthly(spark, values, start=2000, cell=0):
    return spark.createDataFrame([(cell, date(start + i // 12, i % 12 + 1, 1), None if v is None else float(v)) for i, v in enumerate(values)], "cell_id int, month date, value double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("part,extremum,want", [("day", "max", 21), ("day", "min", 6), ("night", "max", 23), ("night", "min", 0)])
def test_temp_extremum(spark, part, extremum, want):
    got = resample.temp_extremum(cube(spark, list(range(24)) * 2), "v", extremum=extremum, part=part)
    assert column(got, "v", "day") == [want, want]


def test_bad_arguments(spark):
    c = cube(spark, [1])
    for call in (
        lambda: resample.temp_extremum(c, "v", extremum="median", part="day"),
        lambda: resample.temp_extremum(c, "v", extremum="max", part="afternoon"),
        lambda: rolling.percentile_thresholds(c, "v", percentile=90, reference=("2001-01-01", "2001-12-31"), part="midi"),
        lambda: rolling.percentile_thresholds(c, "v", percentile=90, reference=("2001-01-01", "2001-12-31"), part="day", kernel="other"),
        lambda: resample.resample_daily(c, "v", "median"),
        lambda: standardize.aggregate_granularity(monthly(spark, [1]), "decade", values=["value"]),
        lambda: sealevel.monthly_stat(c, reference=("2001-01-01", "2001-12-31"), stats="median"),
    ):
        with pytest.raises(ValueError):
            call()


def test_resample_daily_nulls_and_functions(spark):
    c = cube(spark, [1, None, 3] + [None] * 21 + [None] * 24 + [float("nan"), 5])
    assert column(resample.resample_daily(c, "v", "sum"), "v", "day") == [4, None, 5]
    assert column(resample.resample_daily(c, "v", "mean"), "v", "day") == [2, None, 5]
    assert column(resample.resample_daily(c, "v", F.stddev_samp), "v", "day")[0] == pytest.approx(math.sqrt(2))


def test_resample_monthly_of_a_series(spark):
    d = daily(spark, [1] * 31 + [3] * 28)
    got = resample.resample_monthly(d, "value", "mean", keys=())
    assert [(r["month"], r["value"]) for r in got.orderBy("month").collect()] == [(date(2001, 1, 1), 1), (date(2001, 2, 1), 3)]


@pytest.mark.parametrize(
    "values,window,start,want",
    [(range(1, 11), 3, date(2001, 1, 1), [27]), ([7], 5, date(2001, 1, 1), [None]), ([5, 10, 2, 1, 1, 100], 2, date(2001, 1, 29), [15, 101])],
)
def test_max_precipitation(spark, values, window, start, want):
    assert column(rolling.max_precipitation_daily(daily(spark, values, start), window=window), "value", "month") == want


def test_max_precipitation_of_hours_and_partial_nulls(spark):
    got = rolling.max_precipitation(cube(spark, [1 / 24] * 240, name="tp"), window=5)
    assert column(got, "value", "month") == [pytest.approx(5, abs=1e-8)]
    assert column(rolling.rolling_sum(daily(spark, [1, 2, None, 4, 5, 6]), "value", 2), "value", "day") == [None, 3, None, None, 9, 11]


def plain_thresholds(times, values, share, part, start, end):
    width = 80 if part == "day" else 40
    left = (width - 1) // 2
    keep = [(t, v) for t, v in zip(times, values) if (6 <= t.hour <= 21) == (part == "day") and start <= t <= end]
    by: dict[int, list] = {}
    for i, (t, _) in enumerate(keep):
        doy = t.timetuple().tm_yday
        by.setdefault(doy, [])
        if i >= left and i + width - left <= len(keep):
            window = [v for _, v in keep[i - left : i - left + width] if v is not None]
            if window:
                by[doy].append(np.quantile(window, share))
    return {d: (np.quantile(x, share) if x else None) for d, x in by.items()}


@pytest.mark.parametrize("kernel", ["native", "pandas"])
@pytest.mark.parametrize("part", ["day", "night"])
def test_percentile_thresholds(spark, kernel, part):
    rng = np.random.default_rng(5)
    n = 24 * 40
    values = [None if rng.random() < 0.05 else float(x) for x in rng.normal(10, 5, n)]
    start = datetime(2001, 1, 1)
    times = [start + i * HOUR for i in range(n)]
    got = rolling.percentile_thresholds(cube(spark, values), "v", percentile=90, reference=("2001-01-03", "2001-02-05"), part=part, kernel=kernel)
    want = plain_thresholds(times, values, 0.9, part, datetime(2001, 1, 3), datetime(2001, 2, 5))
    assert {r["doy"]: r["thr"] for r in got.collect()} == {d: (None if v is None else pytest.approx(v, abs=1e-9)) for d, v in want.items()}
    assert 36 not in want or part == "night"  # of the last day only the 00:00 sample is in


def test_frequency_counts_days_without_a_flag(spark):
    thr = spark.createDataFrame([(0, i, 5.0) for i in range(1, 10)], "cell_id int, doy int, thr double")
    flags = frequency.crossing_flags(daily(spark, [6, 5, 4, None, 9, 9, 1, 1, 1, 9]), thr, "value", above=True)
    assert column(flags, "flag", "day") == [1, 0, 0, None, 1, 1, 0, 0, 0, None]
    assert column(frequency.monthly_frequency(flags), "value", "month") == [0.3]
    below = frequency.crossing_flags(daily(spark, [6, 5, 4]), thr, "value", above=False)
    assert column(below, "flag", "day") == [0, 0, 1]
    none = flags.withColumn("flag", F.lit(None).cast("int"))
    assert column(frequency.monthly_frequency(none), "value", "month") == [None]


def test_halfday_frequency_is_a_share(spark):
    rng = np.random.default_rng(1)
    c = cube(spark, rng.normal(0, 1, 366 * 24), start=datetime(2000, 1, 1), name="t2m")
    got = frequency.temperature_frequency(c, reference=("2000-01-01", "2000-12-31"))
    values = column(got, "value", "month")
    assert len(values) == 12 and all(0 <= v <= 1 for v in values)


def wind(spark, u, v, days):
    return spark.createDataFrame([(0, datetime(d.year, d.month, d.day), float(a), float(b)) for d, a, b in zip(days, u, v)], "cell_id int, ts timestamp_ntz, u10 double, v10 double")


def test_wind_power(spark):
    one = date(2001, 1, 1)
    assert column(frequency.wind_power(wind(spark, [3, 3], [4, 4], [one, one])), "wp", "day") == [76.875]
    assert column(frequency.wind_power(wind(spark, [0], [0], [one])), "wp", "day") == [0]
    days = [one + timedelta(days=i) for i in range(4)]
    w = wind(spark, [1] * 4, [0] * 4, days)
    assert column(frequency.wind_power(w, reference=("2001-01-02", "2001-01-03")), "wp", "day") == [0.615, 0.615]
    both = frequency.wind_power(w.select("cell_id", "ts", "u10"), w.select("cell_id", "ts", "v10").where("ts > '2001-01-01'"))
    assert column(both, "wp", "day") == [0.615] * 3


def test_wind_thresholds_and_frequency(spark):
    w = wind(spark, [2, 2, 10], [0, 0, 0], [date(y, 1, 1) for y in (2000, 2001, 2002)])
    ref = ("2000-01-01", "2001-12-31")
    wp = frequency.wind_power(w)
    assert column(frequency.wind_thresholds(wp, reference=ref), "thr", "day") == [pytest.approx(4.92)] * 3
    assert column(frequency.wind_days_above(wp, reference=ref), "flag", "day") == [0, 0, 1]
    assert column(frequency.wind_exceedance_frequency(w, reference=ref), "value", "month") == [0, 0, 1]
    assert column(frequency.wind_days_above(wp, reference=("2000-01-01", "2000-12-31")), "flag", "day") == [None] * 3


def plain_cdd(days, values):
    streak, best = 0, {}
    for d, v in zip(days, values):
        best.setdefault(d.year, None)
        if v is None:
            streak = 0
            continue
        streak = streak + 1 if v < 0.001 else 0
        best[d.year] = max(best[d.year] or 0, streak)
    return best


def test_consecutive_dry_days_carry_over_new_year(spark):
    start = date(2001, 12, 18)
    values = [0.01, 0.01] + [0] * 22 + [0.01]
    got = drought.consecutive_dry_days(daily(spark, values, start))
    assert {r["year"]: r["cdd"] for r in got.collect()} == {2001: 12, 2002: 22}


def test_consecutive_dry_days_by_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for cell in range(12):
        days = [date(2000, 11, 1) + timedelta(days=i) for i in range(430)]
        values = [None if rng.random() < 0.03 or cell == 5 else float(rng.choice([0, 0, 0, 0.0005, 0.002])) for _ in days]
        rows += [(cell, d, v) for d, v in zip(days, values)]
        want |= {(cell, y): v for y, v in plain_cdd(days, values).items()}
    df = spark.createDataFrame(rows, "cell_id int, day date, value double").repartition(5)
    assert {(r["cell_id"], r["year"]): r["cdd"] for r in drought.consecutive_dry_days(df).collect()} == want


def test_drought_interpolation(spark):
    cdd = spark.createDataFrame([(0, 2000, 12.0), (0, 2002, 24.0), (1, 2000, None), (1, 2001, 6.0)], "cell_id int, year int, cdd double")
    got = drought.drought_interpolate(cdd)
    zero = column(got.where("cell_id = 0"), "value", "month")
    assert [zero[0], zero[5], zero[11]] == pytest.approx([13, 18, 24]) and zero[12:] == pytest.approx([24] * 12)
    one = column(got.where("cell_id = 1"), "value", "month")
    assert one[:12] == [None] * 12 and one[12:] == pytest.approx([6] * 12)


def test_standardize(spark):
    ref = ("2000-01-01", "2001-12-31")
    m = monthly(spark, list(range(1, 13)) * 2)
    assert column(standardize.standardize(m, reference=ref), "value", "month") == [0] * 24
    two = monthly(spark, [10.0] + [1.0] * 11 + [20.0]).unionByName(monthly(spark, [20.0] + [1.0] * 11 + [10.0], cell=1))
    area = standardize.standardize(two, reference=ref, area=True)
    assert column(area, "value", "month") == [0] * 13
    grid = standardize.standardize(two.where("month(month) = 1"), reference=ref)
    assert sorted(column(grid, "value", "month")) == pytest.approx([-math.sqrt(0.5)] * 2 + [math.sqrt(0.5)] * 2)
    late = standardize.standardize(monthly(spark, range(24)), reference=("2000-01-01", "2000-06-30"))
    assert column(late, "value", "month") == [0] * 6 + [None] * 6 + [12] * 6 + [None] * 6


def test_means_over_space(spark):
    m = spark.createDataFrame([(0, date(2000, 1, 15), 4.0), (1, date(2000, 1, 15), 8.0), (0, date(2000, 2, 15), None), (1, date(2000, 2, 15), 8.0), (0, date(2000, 3, 1), None), (1, date(2000, 3, 1), None)], "cell_id int, month date, value double")
    assert column(standardize.national_mean(m), "value", "month") == [6, 8, None]
    w = spark.createDataFrame([(0, "A", 0.25), (1, "A", 0.75), (1, "B", 0.0)], "cell_id int, unit string, w double")
    got = {(r["unit"], r["month"].month): r["value"] for r in standardize.admin_mean(m, w).collect()}
    assert got == {("A", 1): 7, ("A", 2): 8, ("A", 3): None, ("B", 1): None, ("B", 2): None, ("B", 3): None}


def test_granularity(spark):
    m = monthly(spark, range(1, 13))

    def by(g):
        return {r["period"]: r["value"] for r in standardize.aggregate_granularity(m, g, values=["value"]).collect()}

    assert by("month")["2000-01"] == 1 and by("month")["2000-12"] == 12
    assert by("year") == {"2000": 6.5}
    assert by("semester") == {"2000-S1": 3.5, "2000-S2": 9.5}
    assert by("season") == {"2000-DJF": 1.5, "2000-MAM": 4, "2000-JJA": 7, "2000-SON": 10, "2001-DJF": 12}


def test_labels_to_dates(spark):
    labels = ["2010-01", "2010", "2010-S1", "2010-S2", "2010-DJF", "2010-MAM", "2010-JJA", "2010-SON"]
    df = spark.createDataFrame([(x,) for x in labels], "p string").select("p", dates.label_date(F.col("p")).alias("d"), dates.label_granularity(F.col("p")).alias("g"))
    got = {r["p"]: (r["d"].month, r["g"]) for r in df.collect()}
    assert [got[x][0] for x in labels] == [1, 1, 1, 7, 1, 3, 6, 9]
    assert [got[x][1] for x in labels] == ["Monthly", "Annual", "Semester", "Semester", *["Seasonal"] * 4]
    with pytest.raises(Exception, match="unrecognised period label"):
        spark.createDataFrame([("x",)], "p string").select(dates.label_date(F.col("p"))).collect()


def test_gauge_months(spark):
    texts = ["2011.0417", "2011.1250", "2011.125", "2011.9583", "2011", "2011.5", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", dates.gauge_month(F.col("t")).alias("m"))
    assert column(df, "m", "i") == [date(2011, 1, 1), date(2011, 2, 1), date(2011, 2, 1), date(2011, 12, 1), date(2011, 1, 1), None, None, None]


def test_mask(spark):
    c = spark.createDataFrame([(i, date(2001, 1, 1), 1.0) for i in range(4)], "cell_id int, day date, value double")
    cells = spark.createDataFrame([(0, 1.0), (1, 0.8), (2, 0.79), (3, None)], "cell_id int, land_frac double")
    assert column(mask.apply_mask(c, cells, values=["value"]), "value", "cell_id") == [1, 1, None, None]
    dropped = mask.apply_mask(c, cells, values=[], drop=True)
    assert column(dropped, "cell_id", "cell_id") == [0, 1]
    assert column(mask.all_cells(dropped, cells, time="day"), "value", "cell_id") == [1, 1, None, None]


def test_nearest_mask_of_any_geometry(spark):
    rng = random.Random(3)
    places = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(60, 179.9, 10.0), (61, 359.5, 0.0), (62, None, 3.0)]
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90), rng.random()) for _ in range(12)] + [(-179.9, 10.2, 0.7), (0.1, 0.1, 0.3), (10.0, 20.0, 0.5), (10.0, 20.0, 0.6)]

    def nearest(lon, lat):
        def far(p):
            dx = abs(lon - p[0]) % 360
            return min(dx, 360 - dx) ** 2 + (lat - p[1]) ** 2, *p

        return min(points, key=far)[2]

    cells = spark.createDataFrame(places, "cell_id int, lon double, lat double")
    mask_points = spark.createDataFrame(points, "lon double, lat double, land_frac double")
    want = [nearest(x, y) for _, x, y in places[:-1]] + [None]
    assert want[60] == 0.7 and want[61] == 0.3
    assert column(mask.nearest_mask(cells, mask_points), "land_frac", "cell_id") == want
    assert column(mask.nearest_mask(cells, mask_points.where("lon > 999")), "land_frac", "cell_id") == [None] * len(places)


def test_nearest(spark):
    cells = spark.createDataFrame([(0, 0.1, 45.0), (1, 1.9, 45.0)], "cell_id int, lon double, lat double")
    points = spark.createDataFrame([(0.0, 45.0, 0.2), (2.0, 45.2, 0.9)], "lon double, lat double, land_frac double")
    assert column(mask.nearest_mask(cells, points), "land_frac", "cell_id") == [0.2, 0.9]
    units = spark.createDataFrame([("A", 0.0, 45.0), ("B", 5.0, 45.0)], "unit string, lon double, lat double")
    stations = spark.createDataFrame([(1, 4.0, 45.0), (2, 1.0, 44.0)], "station_id int, lon double, lat double")
    assert column(mask.nearest_unit(stations, units), "unit", "station_id") == ["B", "A"]


def gauges(spark, series):
    rows = [(s, date(2000 + i // 12, i % 12 + 1, 1), None if v is None else float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id int, month date, level double")


def test_sealevel_scale_is_the_country(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(7000, 30, 36)
    obs = sealevel.clean(gauges(spark, {1: [*base[:-1], -99999], 2: base + 100}))
    assert obs.where("level is null").count() == 1
    z = sealevel.standardize(obs, reference=("2000-01-01", "2002-12-31"), study=("2001-01-01", "2002-12-31"))
    got = {(r["station_id"], r["month"]): r["value"] for r in z.collect()}
    assert len(got) == 47
    means = base + 50
    means[-1] = base[-1] + 100
    for m in range(12):
        three = means[m::12]
        sd = three.std(ddof=1)
        if m < 11:
            assert got[2, date(2001, m + 1, 1)] - got[1, date(2001, m + 1, 1)] == pytest.approx(100 / sd)
        assert got[2, date(2001, m + 1, 1)] == pytest.approx((base[12 + m] + 100 - three.mean()) / sd)


def test_sealevel_regions(spark):
    a = spark.createDataFrame([(1, date(2000, 1, 1), 1.0), (2, date(2000, 1, 1), 3.0), (2, date(2000, 2, 1), 5.0)], "station_id int, month date, value double")
    assert column(sealevel.region_mean(a), "sealevel", "month") == [2, 5]
    places = spark.createDataFrame([("A", 1), ("B", 2)], "unit string, station_id int")
    units = spark.createDataFrame([("A",), ("B",), ("C",)], "unit string")
    got = {(r["unit"], r["month"].month): r["sealevel"] for r in sealevel.region_mean(a, admin_stations=places, units=units).collect()}
    assert got == {("A", 1): 1, ("A", 2): None, ("B", 1): 3, ("B", 2): 5, ("C", 1): None, ("C", 2): None}


def test_idw(spark):
    cells = spark.createDataFrame([(0, 0.0, 45.0), (1, 2.0, 45.0), (2, 30.0, 45.0)], "cell_id int, lon double, lat double")
    stations = spark.createDataFrame([(1, 0.0, 45.0), (2, 4.0, 45.0)], "station_id int, lon double, lat double")
    a = spark.createDataFrame([(1, date(2000, 1, 1), 1.0), (2, date(2000, 1, 1), 3.0), (2, date(2000, 2, 1), 5.0), (1, date(2000, 2, 1), None)], "station_id int, month date, value double")
    got = {(r["cell_id"], r["month"].month): r["value"] for r in sealevel.interpolate(a, cells, stations).collect()}
    assert got[0, 1] == pytest.approx(1, abs=1e-6) and got[1, 1] == pytest.approx(2) and got[0, 2] == got[1, 2] == 5
    assert got[2, 1] is None and got[2, 2] is None and len(got) == 6


def test_haversine(spark):
    d = spark.range(1).select(physics.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d")).first()["d"]
    assert d == pytest.approx(6371.0088 * math.pi / 2)
    assert spatial.ring_length_km([(0, 0), (0, 90)]) == pytest.approx(6371.0088 * math.pi)


def test_admin_weights_from_polygons(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 5.0, 5.0)], "cell_id int, lon double, lat double")
    square = [(-0.5, -0.5), (0.25, -0.5), (0.25, 0.5), (-0.5, 0.5)]
    triangle = [(0.75, -0.25), (1.25, -0.25), (1.25, 0.25), (0.75, -0.25)]
    rows = [("A", [{"lon": float(x), "lat": float(y)} for x, y in square]), ("B", [{"lon": float(x), "lat": float(y)} for x, y in triangle])]
    polygons = spark.createDataFrame(rows, "unit string, ring array<struct<lon: double, lat: double>>")
    got = {(r["cell_id"], r["unit"]): r["w"] for r in spatial.build_admin_weights(cells, polygons, half_width=0.5).collect()}
    assert got == {(0, "A"): pytest.approx(0.75), (1, "B"): pytest.approx(0.125)}
    alpha = spark.createDataFrame([("A", 50.0, 100.0), ("B", 200.0, 100.0), ("C", None, 10.0)], "unit string, coast_km double, perimeter_km double")
    assert column(spatial.coastal_alpha(alpha), "alpha", "unit") == [0.5, 1.0, 0.0]
