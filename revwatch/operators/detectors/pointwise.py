"""Detectors that compare a value with statistics of its series: z, rolling z, IQR fence, MAD, sigma band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.numeric import safe_divide
from revwatch.operators.features import long_features

# Features and hyper-parameters of the grid.
ZSCORE_FEATURES = ("daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_diff")
ZSCORE_THRESHOLDS = (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0)
SERIES_FEATURES = ("daily_revenue", "order_count", "avg_order_value")
SERIES_WINDOWS = (5, 7, 10, 14, 21, 30, 45)
SERIES_THRESHOLDS = (1.5, 2.0, 2.5, 3.0, 3.5)
IQR_MULTIPLIERS = (1.5, 2.0, 2.5, 3.0)
MAD_THRESHOLDS = (2.5, 3.0, 3.5)
MAD_SCALE = 1.4826

# Scores are rounded before they meet a threshold, so that a score equal to it never flags by a last-bit error.
SCORE_DIGITS = 9


def zscore_scores(features: DataFrame, series_key: Sequence[str] = (), columns=ZSCORE_FEATURES) -> DataFrame:
    w = Window.partitionBy(*series_key, "feature_set")
    score = F.round(F.abs(safe_divide(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w))), SCORE_DIGITS)
    return long_features(features, columns, series_key).withColumn("score", score).drop("x")


def rolling_scores(
    features: DataFrame, series_key: Sequence[str] = (), columns=SERIES_FEATURES, windows=SERIES_WINDOWS
) -> DataFrame:
    """|z| against the trailing window, which includes the day itself; undefined z counts as 0."""
    days = Window.partitionBy(*series_key, "feature_set").orderBy("order_date")

    def score(rows: int):
        w = days.rowsBetween(-(rows - 1), Window.currentRow)
        spread = F.coalesce(F.stddev_samp("x").over(w), F.lit(1.0))
        z = F.coalesce(F.abs(F.try_divide(F.col("x") - F.avg("x").over(w), spread)), F.lit(0.0))
        return F.round(z, SCORE_DIGITS)

    wide = long_features(features, columns, series_key).withColumns({f"w{n}": score(n) for n in windows})
    per_window = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"w{n}").alias("score")) for n in windows])
    return wide.select(*series_key, "order_date", "is_true_anomaly", "feature_set", F.inline(per_window))


def iqr_scores(features: DataFrame, series_key: Sequence[str] = (), columns=ZSCORE_FEATURES) -> DataFrame:
    """Distance outside the quartiles in units of the interquartile range; 0 inside."""
    w = Window.partitionBy(*series_key, "feature_set")
    frame = long_features(features, columns, series_key).withColumn(
        "q", F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    )
    outside = F.greatest(F.col("x") - F.col("q")[1], F.col("q")[0] - F.col("x"), F.lit(0.0))
    score = F.round(safe_divide(outside, F.col("q")[1] - F.col("q")[0]), SCORE_DIGITS)
    return frame.withColumn("score", score).drop("x", "q")


def mad_scores(features: DataFrame, series_key: Sequence[str] = (), columns=ZSCORE_FEATURES) -> DataFrame:
    """Distance from the median in units of the scaled median absolute deviation."""
    w = Window.partitionBy(*series_key, "feature_set")
    gap = long_features(features, columns, series_key).withColumn("gap", F.abs(F.col("x") - F.median("x").over(w)))
    score = F.round(safe_divide(F.col("gap"), F.lit(MAD_SCALE) * F.median("gap").over(w)), SCORE_DIGITS)
    return gap.withColumn("score", score).drop("x", "gap")


def sigma_band(daily: DataFrame, value: str = "daily_revenue", k: float = 2.5, series_key=()) -> DataFrame:
    """Days outside mean ± k sample deviations, with both limits."""
    w = Window.partitionBy(*series_key)
    centre, spread = F.avg(value).over(w), F.lit(k) * F.stddev_samp(value).over(w)
    banded = daily.select(
        *series_key,
        "order_date",
        value,
        (centre - spread).alias("lower_limit"),
        (centre + spread).alias("upper_limit"),
    )
    return banded.filter((F.col(value) > F.col("upper_limit")) | (F.col(value) < F.col("lower_limit")))


def alert_driver(daily: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    """For every flagged day, the KPI that deviates most from its own mean."""
    metrics = ("daily_revenue", "order_count", "avg_order_value", "avg_freight")
    w = Window.partitionBy(*series_key)
    z = {f"z_{m}": F.round(safe_divide(F.col(m) - F.avg(m).over(w), F.stddev_samp(m).over(w)), 6) for m in metrics}
    flagged = daily.withColumns(z).filter(F.col("anomaly_flag") == 1)
    # Ties go to the metric named first.
    ranked = F.greatest(
        *[
            F.struct(F.abs(f"z_{m}").alias("size"), F.lit(-i).alias("tie"), F.lit(m).alias("metric"),
                     F.col(f"z_{m}").alias("z"))
            for i, m in enumerate(metrics)
        ]
    )
    return flagged.withColumn("top", ranked).select(
        *series_key, "order_date", F.col("top.metric").alias("driver"), F.col("top.z").alias("driver_z")
    )
