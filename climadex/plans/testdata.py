"""The engine's tables out of the star schema of the test data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = ("1995-01-01", "1998-12-31")
STUDY = ("1995-01-01", "2001-12-31")
THRESHOLD = 0.9


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """climate_hourly: regions are cells, line items are observations."""
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # The dimensions are joined first; Spark broadcasts them when they are small.
    rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    hour = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3, F.lit(24)).cast("int")
    ts = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)
    price = F.col("l_extendedprice").cast("double") / 1e8
    return rows.groupBy(F.col("n_regionkey").cast("int").alias("cell_id"), ts.alias("ts")).agg(
        (F.avg(F.col("l_quantity").cast("double")) + 263.15).alias("t2m"),
        F.sum(F.when(F.col("l_quantity") > 25, price).otherwise(0.0)).alias("tp"),
        F.avg(F.col("l_discount").cast("double") * 100).alias("u10"),
        F.avg(F.col("l_tax").cast("double") * 100).alias("v10"),
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    share = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.avg(F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.0)).alias("land_frac"))
    r = F.col("r_regionkey")
    return _t(spark, sf_dir, "region").join(share, r == F.col("n_regionkey"), "left").select(r.cast("int").alias("cell_id"), (r * 3.0 - 6).alias("lon"), (42 + r * 2.0).alias("lat"), "land_frac")


def admin_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.concat(F.lit("U"), (F.col("n_nationkey") % 3).cast("string")).alias("unit")
    return _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("int").alias("cell_id"), unit).agg((F.count(F.lit(1)) / 5.0).alias("w"))


def admin_alpha(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("U0", 0.6), ("U1", 0.3), ("U2", 0.0)], "unit string, alpha double")


def admin_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the units U0 and U1; U2 has none."""
    k = F.col("n_nationkey")
    return _t(spark, sf_dir, "nation").where(k % 3 < 2).select(F.concat(F.lit("U"), (k % 3).cast("string")).alias("unit"), k.cast("int").alias("station_id"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _t(spark, sf_dir, "nation").select(k.cast("int").alias("station_id"), F.lit("XXX").alias("country"), (40.0 + (k * 7) % 13).alias("lat"), (-6 + k * 0.9).cast("double").alias("lon"))


def sealevel_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value per nation; every 29th month of a station has the sentinel instead."""
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    month = F.trunc(F.to_date("o_orderdate"), "month")
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").cast("int").alias("station_id"), month.alias("month")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("level"))
    gap = (F.year("month") * 12 + F.month("month") + F.col("station_id")) % 29 == 0
    return out.withColumn("level", F.when(gap, -99999.0).otherwise(F.col("level")))


def mask_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse mask of a point per nation."""
    return stations(spark, sf_dir).select("lon", "lat", (F.col("station_id") / 24.0).alias("land_frac"))


def unit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of three by two degrees around each station, dealt to three units."""

    def corner(x, y):
        return F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))

    ring = F.array(corner(-1.5, -1.0), corner(1.5, -1.0), corner(1.5, 1.0), corner(-1.5, 1.0))
    return stations(spark, sf_dir).select(F.concat(F.lit("U"), (F.col("station_id") % 3).cast("string")).alias("unit"), ring.alias("ring"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors reach; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/climate-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def gauge_folder(spark: SparkSession, sf_dir: str) -> str:
    """The gauge records as text files, one per station (25 of them, a row per month)."""
    folder = shared_folder(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files: dict[int, list[str]] = {}
    for r in sealevel_obs(spark, sf_dir).orderBy("station_id", "month").collect():
        files.setdefault(r["station_id"], []).append(f" {r['month'].year + (r['month'].month - 0.5) / 12:.4f};{r['level']!r};N;000")
    for station, lines in files.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{station}.txt"))
        out.write(bytearray(("\n".join(lines) + "\n").encode()))
        out.close()
    return folder
