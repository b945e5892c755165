"""Daily reductions of arriving hourly rows.

Thresholds and z-scores need the closed reference period, so they stay batch; the daily
cubes they start from can be kept up to date by a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import reducer
from ..schema import CLIMATE_HOURLY, known


def read_hourly(spark: SparkSession, folder: str, *, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; each is read once."""
    return spark.readStream.schema(CLIMATE_HOURLY.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_stream(stream: DataFrame, value: str, how="mean", *, late: str = "1 day") -> DataFrame:
    """(cell_id, day, value): days close once the watermark has passed their end."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "cell_id").agg(reducer(how)(known(value)).alias(value))
    return days.select("cell_id", F.to_date("window.start").alias("day"), value)


def write_daily(daily: DataFrame, folder: str, checkpoint: str):
    """Append closed days to a Parquet folder, one pass over what is there."""
    return daily.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
