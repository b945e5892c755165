"""Rolling windows over the rows of a cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import known, within
from .resample import part_of_day, resample_daily

#: Rows of the centred window: five days of 16 day hours or of 8 night hours.
PART_WINDOW = {"day": 80, "night": 40}


def rolling_sum(daily: DataFrame, value: str, window: int, *, time: str = "day", out: str | None = None) -> DataFrame:
    """Sum of the last ``window`` rows of a cell; NULL before there are as many, or if one is NULL."""
    if window < 1:
        raise ValueError("window is at least 1")
    w = Window.partitionBy("cell_id").orderBy(time).rowsBetween(-(window - 1), 0)
    total = F.when(F.count(known(value)).over(w) == window, F.sum(known(value)).over(w))
    return daily.withColumn(out or value, total)


def max_precipitation(cube: DataFrame, value: str = "tp", *, window: int = 5) -> DataFrame:
    """(cell_id, month, value): monthly maximum of the rolling sum of daily sums, across months."""
    return max_precipitation_daily(resample_daily(cube, value, "sum", out="value"), window=window)


def max_precipitation_daily(daily: DataFrame, *, window: int = 5) -> DataFrame:
    rolled = rolling_sum(daily, "value", window)
    return rolled.groupBy("cell_id", F.trunc("day", "month").alias("month")).agg(F.max("value").alias("value"))


def _quantiles(rows: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Quantiles along the last axis, NaN left out, interpolated as ``percentile`` does; (shares, rows)."""
    rows = np.sort(rows, axis=-1)  # NaN last
    n = (~np.isnan(rows)).sum(axis=-1)
    out = np.full((len(shares), len(rows)), np.nan)
    at, live = np.arange(len(rows)), n > 0
    for k, share in enumerate(shares):
        spot = share * np.maximum(n - 1, 0)
        low, high = np.floor(spot).astype(int), np.ceil(spot).astype(int)
        a, b = rows[at, low], rows[at, high]
        out[k] = np.where(live, np.where((low == high) | (a == b), a, (high - spot) * a + (spot - low) * b), np.nan)
    return out


def _rolled(v: np.ndarray, width: int, shares: tuple[float, ...]) -> np.ndarray:
    """Centred rolling quantiles of complete windows, NaN elsewhere; (shares, rows)."""
    left = (width - 1) // 2
    q = np.full((len(shares), len(v)), np.nan)
    if len(v) >= width:
        # Views of the windows, a block of 4096 is copied at a time.
        views = np.lib.stride_tricks.sliding_window_view(v, width)
        for i in range(0, len(views), 4096):
            part = views[i : i + 4096]
            q[:, left + i : left + i + len(part)] = _quantiles(part, shares)
    return q


def part_thresholds(cube: DataFrame, value: str = "t2m", *, percentiles: tuple[float, ...], reference: tuple[str, str], parts: tuple[str, ...] = ("day", "night")) -> DataFrame:
    """(cell_id, doy, <part>_0, <part>_1, ...): the thresholds of several percentiles and parts of the day.

    One pass over the hours of the reference period, which are dealt by cell; a cell's hours
    (some hundred thousand) are rolled by numpy.
    """
    shares = tuple(p / 100 for p in percentiles)
    names = [f"{part}_{k}" for part in parts for k in range(len(shares))]
    rows = cube.where(within(F.col("ts"), reference)).select("cell_id", "ts", known(value).alias("v"), part_of_day("day").alias("d"))
    if len(parts) == 1:
        rows = rows.where(part_of_day(parts[0]))

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found: dict[int, dict[str, float]] = {}
        for part in parts:
            own = pdf[pdf["d"] == (part == "day")]
            v, doy = own["v"].to_numpy(dtype=float), own["ts"].dt.dayofyear.to_numpy()
            q = _rolled(v, PART_WINDOW[part], shares)
            order = np.argsort(doy, kind="stable")
            days, starts, sizes = np.unique(doy[order], return_index=True, return_counts=True)
            for k, share in enumerate(shares):
                # The days of the year side by side, filled up with NaN.
                table = np.full((len(days), sizes.max(initial=0)), np.nan)
                table[np.repeat(np.arange(len(days)), sizes), np.arange(len(doy)) - np.repeat(starts, sizes)] = q[k][order]
                for day, thr in zip(days.tolist(), _quantiles(table, (share,))[0].tolist()):
                    found.setdefault(day, {})[f"{part}_{k}"] = thr
        out = pd.DataFrame({"cell_id": pdf["cell_id"].iloc[0], "doy": sorted(found)})
        for c in names:
            out[c] = [None if np.isnan(x := found[d].get(c, np.nan)) else x for d in out["doy"]]
        return out

    return rows.groupBy("cell_id").applyInPandas(roll, "cell_id int, doy int, " + ", ".join(f"{c} double" for c in names))


def percentile_thresholds(cube: DataFrame, value: str = "t2m", *, percentile: float, reference: tuple[str, str], part: str, kernel: str = "pandas") -> DataFrame:
    """(cell_id, doy, thr): day-of-year thresholds of the reference period.

    A centred rolling percentile over rows of the part of the day (offset one to the right,
    as the width is even; complete windows only, counted in rows; NULLs inside are skipped),
    then the same percentile of the rolled values per calendar day of the year.
    ``kernel="pandas"`` computes with numpy, a cell at a time; ``"native"`` with a window of
    the planner, which is slower and gives the same values.
    """
    if part not in PART_WINDOW:
        raise ValueError(f"part must be 'day' or 'night', not {part!r}")
    if not 0 <= percentile <= 100:
        raise ValueError("percentile is between 0 and 100")
    width, share = PART_WINDOW[part], percentile / 100
    left = (width - 1) // 2
    if kernel == "pandas":
        return part_thresholds(cube, value, percentiles=(percentile,), reference=reference, parts=(part,)).select("cell_id", "doy", F.col(f"{part}_0").alias("thr"))
    if kernel != "native":
        raise ValueError(f"kernel must be 'native' or 'pandas', not {kernel!r}")
    rows = cube.where(part_of_day(part) & within(F.col("ts"), reference)).select("cell_id", "ts", known(value).alias(value))
    w = Window.partitionBy("cell_id").orderBy("ts").rowsBetween(-left, width - 1 - left)
    rolled = rows.select("cell_id", "ts", F.when(F.count(F.lit(1)).over(w) == width, F.percentile(value, share).over(w)).alias("q"))
    return rolled.groupBy("cell_id", F.dayofyear("ts").alias("doy")).agg(F.percentile("q", share).alias("thr"))
