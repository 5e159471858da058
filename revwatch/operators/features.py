"""Feature frame over the daily series, feature sets and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.numeric import MONEY

# The columns of each named feature set.
FEATURE_SETS = {
    "revenue_only": ["daily_revenue"],
    "rev_orders": ["daily_revenue", "order_count"],
    "rev_freight": ["daily_revenue", "avg_freight"],
    "multi_feature": ["daily_revenue", "order_count", "avg_order_value", "avg_freight"],
    "temporal_basic": ["daily_revenue", "revenue_ma7", "revenue_diff"],
    "temporal_full": [
        "daily_revenue", "order_count", "revenue_ma7", "revenue_ma30", "revenue_std7", "revenue_diff",
    ],
    "all_features": [
        "daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_std7",
        "revenue_diff", "day_of_week",
    ],
}
BASE_FEATURES = ("daily_revenue", "order_count", "avg_order_value", "avg_freight")
ALL_FEATURES = (
    *BASE_FEATURES, "revenue_ma7", "revenue_ma30", "revenue_std7", "orders_ma7", "revenue_diff",
    "revenue_pct_change", "day_of_week",
)


def build_features(labelled: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    """Base, rolling, difference and calendar features of every day, with the label carried along.

    Rolling frames count rows, not calendar days. Rolling means add decimals, so they do not depend on summation order.
    """
    everything = Window.partitionBy(*series_key)
    days = everything.orderBy("order_date")

    def last(rows: int):
        return days.rowsBetween(-(rows - 1), Window.currentRow)

    filled = labelled.select(
        *series_key,
        "order_date",
        *[F.coalesce(F.col(c).cast("double"), F.avg(c).over(everything)).alias(c) for c in BASE_FEATURES],
        F.col("is_true_anomaly"),
    )
    revenue, amount = F.col("daily_revenue"), F.col("daily_revenue").cast(MONEY)
    previous = F.lag("daily_revenue").over(days)

    def mean_over(col, rows: int):
        return F.sum(col).over(last(rows)).cast("double") / F.count(col).over(last(rows))

    return filled.withColumns(
        {
            "revenue_ma7": mean_over(amount, 7),
            "revenue_ma30": mean_over(amount, 30),
            "revenue_std7": F.coalesce(F.stddev_samp("daily_revenue").over(last(7)), F.lit(0.0)),
            "orders_ma7": mean_over(F.col("order_count"), 7),
            "revenue_diff": F.coalesce((amount - F.lag(amount).over(days)).cast("double"), F.lit(0.0)),
            "revenue_pct_change": F.coalesce(F.try_divide(revenue, previous) - 1, F.lit(0.0)),
            "day_of_week": F.weekday("order_date").cast("double"),
        }
    )


def scale_standard(df: DataFrame, columns: Sequence[str], series_key: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    w = Window.partitionBy(*series_key)
    return df.withColumns(
        {
            c: F.round(
                F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)), digits
            )
            for c in columns
        }
    )


def scale_minmax(df: DataFrame, columns: Sequence[str], series_key: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    w = Window.partitionBy(*series_key)
    return df.withColumns(
        {
            c: F.round(
                F.coalesce(
                    F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)
                ),
                digits,
            )
            for c in columns
        }
    )


def scale_robust(df: DataFrame, columns: Sequence[str], series_key: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(x - median) / interquartile range; a zero range divides by 1.

    ``percentile`` sees one series at a time, which the calendar bounds.
    """
    w = Window.partitionBy(*series_key)

    def scaled(c: str):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        spread = F.nullif(q[2] - q[0], F.lit(0.0))
        return F.round((F.col(c) - q[1]) / F.coalesce(spread, F.lit(1.0)), digits)

    return df.withColumns({c: scaled(c) for c in columns})


def feature_vectors(
    features: DataFrame, series_key: Sequence[str] = (), feature_sets: dict[str, list[str]] | None = None
) -> DataFrame:
    """Long form: one row per (series, day, feature set) with the standard-scaled vector."""
    feature_sets = feature_sets or FEATURE_SETS
    used = sorted({c for cols in feature_sets.values() for c in cols})
    scaled = scale_standard(features, used, series_key)
    sets = F.array(
        *[
            F.struct(F.lit(name).alias("feature_set"), F.array(*[F.col(c) for c in cols]).alias("vec"))
            for name, cols in feature_sets.items()
        ]
    )
    return scaled.select(*series_key, "order_date", "is_true_anomaly", F.inline(sets))


def long_features(features: DataFrame, columns: Sequence[str], series_key: Sequence[str] = ()) -> DataFrame:
    """One row per (series, day, feature) with column ``x``."""
    return features.unpivot([*series_key, "order_date", "is_true_anomaly"], list(columns), "feature_set", "x")
