"""Tide-gauge text files and station lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import gauge_month

REQUIRED = ("ID", "Country", "Lat.", "Lon.")


def load_gauges(spark: SparkSession, directory: str) -> DataFrame:
    """(station_id, month, level) of all ``<id>.txt`` files: ``date;level;flag;flag``, no header.

    Rows of a date that names no month are left out; the sentinel is still there.  A folder
    without such a file is an error.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/*.txt")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no gauge record (.txt) in {directory}")
    raw = (
        spark.read.schema("date string, level string, flag1 string, flag2 string")
        .option("sep", ";")
        .option("pathGlobFilter", "*.txt")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(directory)
    )
    station = F.try_to_number(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1), F.lit("9999999999")).cast("int")
    rows = raw.select(station.alias("station_id"), gauge_month(F.col("date")).alias("month"), F.expr("try_cast(level AS double)").alias("level"))
    return rows.where(F.col("station_id").isNotNull() & F.col("month").isNotNull())


def load_stations(spark: SparkSession, path: str, *, country: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """(station_id, country, lat, lon) of a station list, of a country or of some stations."""
    raw = spark.read.option("header", True).csv(path)
    found = {c.strip(): c for c in raw.columns}
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"the station list lacks {', '.join(missing)}")
    col = {c: F.trim(F.col(f"`{found[c]}`")) for c in REQUIRED}
    out = raw.select(col["ID"].cast("int").alias("station_id"), col["Country"].alias("country"), col["Lat."].cast("double").alias("lat"), col["Lon."].cast("double").alias("lon"))
    if country is not None:
        out = out.where(F.col("country") == country)
    if ids is not None:
        out = out.where(F.col("station_id").isin(ids))
    return out
