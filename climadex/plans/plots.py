"""Plot-ready frames (no renderer): series, components, distributions, maps, animation."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import label_date, label_granularity

REQUIRED = ("precipitation", "drought", "wind", "sealevel", "aci")


def temperature_columns(df: DataFrame) -> tuple[str, str]:
    """The two temperature columns, (high, low): lowest numbers first decide low."""
    t = sorted((c for c in df.columns if re.fullmatch(r"t\d+", c)), key=lambda c: int(c[1:]))
    if len(t) < 2:
        raise ValueError("an index has a high and a low temperature column, t90 and t10 for example")
    return t[1], t[0]


def check_index(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"not an index: no {', '.join(missing)}")
    temperature_columns(df)


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.2) -> np.ndarray:
    """Local quadratic fits with tricube weights, at each x."""
    n = len(x)
    k = min(n, max(3, int(np.ceil(span * n))))
    out = np.full(n, np.nan)
    for i in range(n):
        d = np.abs(x - x[i])
        at = np.argsort(d, kind="stable")[:k]
        h = max(d[at].max(), 1e-12)
        w = np.sqrt(np.clip(1 - (d[at] / h) ** 3, 0, 1) ** 3 + 1e-12)
        a = np.vander((x[at] - x[i]) / h, 3, increasing=True)
        out[i] = np.linalg.lstsq(a * w[:, None], y[at] * w, rcond=None)[0][0]
    return out


def timeseries(index: DataFrame) -> DataFrame:
    """(date, aci, ribbon_min, ribbon_max, granularity) of a national index."""
    check_index(index)
    a = F.col("aci")
    # least() and greatest() skip NULLs, a missing value has no ribbon.
    low, high = F.when(a.isNotNull(), F.least(a, F.lit(0.0))), F.when(a.isNotNull(), F.greatest(a, F.lit(0.0)))
    return index.select(label_date(F.col("period")).alias("date"), "aci", low.alias("ribbon_min"), high.alias("ribbon_max"), label_granularity(F.col("period")).alias("granularity"))


def smoothed(index: DataFrame, *, span: float = 0.2) -> pd.DataFrame:
    """The series with a local trend; a national series has a row per period only."""
    pdf = timeseries(index).orderBy("date").toPandas()
    good = pdf["aci"].notna().to_numpy()
    pdf["trend"] = np.nan
    if good.sum() > 3:
        x = pd.to_datetime(pdf["date"]).astype("int64").to_numpy(dtype=float)[good]
        pdf.loc[good, "trend"] = loess((x - x.min()) / max(np.ptp(x), 1), pdf["aci"].to_numpy(dtype=float)[good], span)
    return pdf


def _components(index: DataFrame, components: list[str] | None) -> list[str]:
    check_index(index)
    every = [*temperature_columns(index), "precipitation", "drought", "wind", "sealevel"]
    chosen = components or every
    unknown = [c for c in chosen if c not in every]
    if unknown:
        raise ValueError(f"unknown component(s): {', '.join(unknown)}; available: {', '.join(every)}")
    return chosen


def components(index: DataFrame, *, components: list[str] | None = None) -> DataFrame:
    """(date, component, value), a row per period and component."""
    chosen = _components(index, components)
    return index.select(label_date(F.col("period")).alias("date"), *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot("date", chosen, "component", "value")


def distribution(index: DataFrame, *, components: list[str] | None = None, include_index: bool = True) -> DataFrame:
    """(component, n, low, q25, q50, q75, high): what boxes and violins draw."""
    chosen = _components(index, components) + ["aci"] * include_index
    long = index.select(*[F.col(c).cast("double").alias(c) for c in chosen]).unpivot([], chosen, "component", "value")
    q = F.percentile("value", [0.25, 0.5, 0.75])
    return long.groupBy("component").agg(F.count("value").alias("n"), F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high")).select("component", "n", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high")


def density(index: DataFrame, *, components: list[str] | None = None, include_index: bool = True, points: int = 64) -> DataFrame:
    """(component, x, density): Gaussian kernel densities at even points between the ends, for violins.

    Bandwidth after Silverman's rule, 0.9 min(sd, iqr / 1.34) n**-0.2; components without two
    different values are left out.  Values meet the points by a fixed list of ``points``.
    """
    chosen = _components(index, components) + ["aci"] * include_index
    long = index.select(*[F.col(c).cast("double").alias(c) for c in chosen]).unpivot([], chosen, "component", "value").where(F.col("value").isNotNull())
    q = F.percentile("value", [0.25, 0.75])
    stats = long.groupBy("component").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("sd"), (q[1] - q[0]).alias("iqr"))
    spread = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    stats = stats.where("high > low").withColumn("h", 0.9 * spread * F.pow(F.col("n"), F.lit(-0.2)))
    rows = long.join(stats, "component").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / F.lit(points - 1)
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("value")) / F.col("h"), F.lit(2))) / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi)))
    return rows.withColumn("x", x).withColumn("y", kernel).groupBy("component", "k").agg(F.first("x").alias("x"), F.sum("y").alias("density")).select("component", "x", "density")


def dashboard(index: DataFrame) -> dict[str, DataFrame]:
    """The four panels by name."""
    return {"timeseries": timeseries(index), "components": components(index), "distribution": distribution(index), "density": density(index)}


def period_between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Periods by comparison of their labels."""
    if start is not None:
        df = df.where(F.col("period") >= start)
    if end is not None:
        df = df.where(F.col("period") <= end)
    return df


def map_frame(index: DataFrame, variable: str = "aci", *, period: str | None = None, key: str = "cell_id", cells: DataFrame | None = None) -> DataFrame:
    """(key[, lon, lat], value) of one period, or the mean over all; keys without a value are left out."""
    if variable not in index.columns:
        raise ValueError(f"no variable {variable!r}")
    rows = index if period is None else index.where(F.col("period") == period)
    out = rows.groupBy(key).agg(F.avg(variable).alias("value")).where(F.col("value").isNotNull())
    return out.join(cells.select(key, "lon", "lat"), key) if cells is not None else out


def map_mean(index: DataFrame, variable: str = "aci", *, start: str | None = None, end: str | None = None, key: str = "cell_id", cells: DataFrame | None = None) -> DataFrame:
    return map_frame(period_between(index, start, end), variable, key=key, cells=cells)


def animation(index: DataFrame, variable: str = "aci", *, key: str = "cell_id", cells: DataFrame | None = None) -> DataFrame:
    """(key[, lon, lat], period, value), all frames in one table."""
    if variable not in index.columns:
        raise ValueError(f"no variable {variable!r}")
    out = index.select(key, "period", F.col(variable).alias("value")).where(F.col("value").isNotNull())
    return out.join(cells.select(key, "lon", "lat"), key) if cells is not None else out
