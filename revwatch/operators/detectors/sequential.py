"""Detectors that read a series in date order: exponentially weighted z, seasonal residual, STL residual."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revwatch.operators.detectors.pointwise import SCORE_DIGITS, SERIES_FEATURES, SERIES_WINDOWS
from revwatch.operators.features import long_features

STL_PERIODS = (7, 14, 21, 30, 60)
SLAB_DAYS = 256


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def ewm_horizon(span: int) -> int:
    """Rows after which a weight is below 1e-16 of the newest one."""
    return math.ceil(math.log(1e-16) / math.log(1 - 2 / (span + 1)))


def ewm_scores(
    features: DataFrame, series_key: Sequence[str] = (), columns=SERIES_FEATURES, spans=SERIES_WINDOWS
) -> DataFrame:
    """|z| against the exponentially weighted mean and bias-corrected deviation (weights adjusted, own day included).

    Weighted sums of 1, y and y squared are prefix sums inside slabs of ``SLAB_DAYS`` rows, where the powers of the decay
    stay in range; a slab's totals reach the next ones through a window over slabs, as far back as weights count.
    """
    keys = [*series_key, "feature_set"]
    days = Window.partitionBy(*keys).orderBy("order_date")
    long = long_features(features, columns, series_key).withColumns(
        {"row": F.row_number().over(days) - 1, "y": F.col("x") - F.first("x").over(days)}
    )
    decays = [F.struct(F.lit(s).alias("span"), F.lit(1 - 2 / (s + 1)).alias("decay")) for s in spans]
    slab, place = F.floor(F.col("row") / SLAB_DAYS), F.col("row") % SLAB_DAYS
    rows = long.select(
        *keys, "order_date", "is_true_anomaly", "y", slab.alias("slab"), place.alias("place"), F.inline(F.array(*decays))
    )
    series = [*keys, "span"]
    upto = Window.partitionBy(*series, "slab").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.pow("decay", -F.col("place"))
    # Each sum with the power of the decay that it fades by in a row.
    sums = {"w": (F.lit(1.0), 1), "w2": (F.lit(1.0), 2), "wy": (F.col("y"), 1), "wyy": (F.col("y") * F.col("y"), 1)}
    rows = rows.withColumns(
        {n: F.sum(F.pow(grown, F.lit(k)) * v).over(upto) * F.pow("decay", k * F.col("place")) for n, (v, k) in sums.items()}
    )
    reach = -(-ewm_horizon(max(spans)) // SLAB_DAYS)
    order = Window.partitionBy(*series).orderBy("slab")

    def carried(name: str, fade: int):
        faded = F.pow("decay", F.lit(fade * SLAB_DAYS))
        parts = [F.coalesce(F.lag(name, q).over(order), F.lit(0.0)) * F.pow(faded, F.lit(q - 1)) for q in range(1, reach + 1)]
        return reduce(add, parts)

    # The last slab has no successor, so only full ones count here.
    totals = rows.filter(F.col("place") == SLAB_DAYS - 1).select(*series, "decay", "slab", *sums)
    ahead = totals.unionByName(
        totals.groupBy(*series, "decay").agg((F.max("slab") + 1).alias("slab"), *[F.lit(0.0).alias(n) for n in sums])
    )
    before = ahead.select(*series, "slab", *[carried(n, k).alias(f"{n}_before") for n, (_, k) in sums.items()])
    joined = rows.join(before, [*series, "slab"], "left")
    total = {
        n: F.col(n) + F.coalesce(F.col(f"{n}_before"), F.lit(0.0)) * F.pow("decay", k * (F.col("place") + 1))
        for n, (_, k) in sums.items()
    }
    out = joined.select(*series, "order_date", "is_true_anomaly", "y", *[c.alias(n) for n, c in total.items()])
    mean, spare = F.col("wy") / F.col("w"), F.col("w") * F.col("w") - F.col("w2")
    variance = F.greatest(F.col("wyy") / F.col("w") - mean * mean, F.lit(0.0)) * F.col("w") * F.col("w")
    spread = F.when(spare > 1e-9, F.sqrt(variance / F.greatest(spare, F.lit(1e-9)))).otherwise(1.0)
    score = F.coalesce(F.abs(F.try_divide(F.col("y") - mean, spread)), F.lit(0.0))
    return out.select(*series, "order_date", "is_true_anomaly", F.round(score, SCORE_DIGITS).alias("score"))


def seasonal_scores(
    features: DataFrame, series_key: Sequence[str] = (), columns=SERIES_FEATURES, periods=STL_PERIODS
) -> DataFrame:
    """|z| of the residual after a centred moving-average trend and the median of each phase, in plain windows."""
    keys = [*series_key, "feature_set"]
    days = Window.partitionBy(*keys).orderBy("order_date")
    frame = long_features(features, columns, series_key).withColumn("row", F.row_number().over(days) - 1)
    for p in periods:
        around = days.rowsBetween(-(p // 2), p // 2)
        frame = frame.withColumn(f"d{p}", F.round(F.col("x") - F.avg("x").over(around), 6))
    per_period = F.array(
        *[
            F.struct(F.lit(p).alias("period"), (F.col("row") % p).alias("phase"), F.col(f"d{p}").alias("detrended"))
            for p in periods
        ]
    )
    long = frame.select(*keys, "order_date", "is_true_anomaly", F.inline(per_period))
    phase = Window.partitionBy(*keys, "period", "phase")
    series = Window.partitionBy(*keys, "period")
    resid = long.withColumn("resid", F.col("detrended") - F.median("detrended").over(phase))
    z = F.abs((F.col("resid") - F.avg("resid").over(series)) / (F.stddev_pop("resid").over(series) + 1e-8))
    return resid.withColumn("score", F.round(z, SCORE_DIGITS)).drop("phase", "detrended", "resid")


# --- STL: seasonal-trend decomposition by local regression (Cleveland et al., 1990) ---


def _loess(y: np.ndarray, width: int, weights: np.ndarray, extend: int = 0) -> np.ndarray:
    """Local linear regression at every index, and at ``extend`` indexes beyond both ends; tricube weights."""
    n = len(y)
    at = np.arange(-extend, n + extend)
    q = min(width, n)
    left = np.clip(at - (q - 1) // 2, 0, n - q)
    idx = left[:, None] + np.arange(q)
    gap = np.abs(idx - at[:, None]).astype(float)
    reach = gap.max(axis=1, keepdims=True) + max(0, (width - n) // 2)
    ratio = gap / np.maximum(reach, 1e-12)
    w = np.where(ratio <= 0.001, 1.0, np.where(ratio < 0.999, (1 - ratio**3) ** 3, 0.0)) * weights[idx]
    total = w.sum(axis=1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 1.0 / q)
    centre = (w * idx).sum(axis=1)
    spread = (w * (idx - centre[:, None]) ** 2).sum(axis=1)
    offset = at - centre
    usable = np.sqrt(spread) > 0.001 * max(n - 1, 1)
    slope = np.where(usable, offset / np.where(usable, spread, 1), 0.0)
    return (w * (1 + slope[:, None] * (idx - centre[:, None])) * y[idx]).sum(axis=1)


def _moving_average(y: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[k:] - total[:-k]) / k


def _odd_above(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


def stl_residual(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> np.ndarray:
    """Residual of a robust STL fit with degree-1 smoothers."""
    n = len(y)
    trend_width = _odd_above(1.5 * period / (1 - 1.5 / seasonal))
    low_width = _odd_above(period + 1)
    robust = np.ones(n)
    trend = np.zeros(n)
    seasonal_part = np.zeros(n)
    for _ in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                sub = _loess(detrended[phase::period], seasonal, robust[phase::period], extend=1)
                cycle[phase::period] = sub
            low = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            low = _loess(low, low_width, np.ones(n))
            seasonal_part = cycle[period : period + n] - low
            trend = _loess(y - seasonal_part, trend_width, robust)
        resid = y - trend - seasonal_part
        bound = 6 * np.median(np.abs(resid))
        if bound <= 1e-12 * np.abs(y).max():  # an exact fit leaves only rounding noise to weigh
            break
        robust = np.clip(1 - (np.abs(resid) / bound) ** 2, 0, 1) ** 2
    return y - trend - seasonal_part


def stl_scores(
    features: DataFrame, series_key: Sequence[str] = (), columns=SERIES_FEATURES, periods=STL_PERIODS
) -> DataFrame:
    """|z| of the STL residual. One task fits one (series, feature, period); a series is bounded by the calendar.

    Series shorter than two periods cannot be decomposed and yield no rows.
    """
    keys = [*series_key, "feature_set"]
    carried = [*keys, "order_date", "is_true_anomaly"]
    fanned = long_features(features, columns, series_key).withColumn(
        "period", F.explode(F.array(*[F.lit(p) for p in periods]))
    )
    schema = T.StructType(
        [
            *_fields(fanned, carried),
            T.StructField("period", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order_date")
        period = int(pdf["period"].iloc[0])
        out = pdf[[*carried, "period"]]
        if len(pdf) < 2 * period:
            return out.iloc[:0].assign(score=pd.Series(dtype=float))
        resid = stl_residual(pdf["x"].to_numpy(float), period)
        return out.assign(score=np.abs((resid - resid.mean()) / (resid.std() + 1e-8)))

    # An explicit partition count keeps the few, slow fits apart; adaptive execution would merge them by size.
    partitions = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    unit = [*keys, "period"]
    return fanned.repartition(partitions, *unit).groupBy(*unit).applyInPandas(fit, schema)
