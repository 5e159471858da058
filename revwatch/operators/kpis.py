"""Daily KPI series, their z-scores and their ground-truth labels.

Every operator takes ``series_key`` columns; an empty key is one series over the whole table. A series holds at most one
row per calendar day, so windows partitioned by series are bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.numeric import mean, money, ratio, safe_divide


def series_window(series_key: Sequence[str] = ()):
    return Window.partitionBy(*series_key)


def zscore(value: str, series_key: Sequence[str] = ()) -> Column:
    w = series_window(series_key)
    return safe_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def daily_totals(fact: DataFrame, series_key: Sequence[str] = (), approx_customers: bool = False) -> DataFrame:
    """Sums, counts and means per series and day. Exact distinct customers cost one more shuffle, by (day, customer);
    ``approx_customers`` trades it for a sketch of about 5 % error."""
    distinct = F.approx_count_distinct if approx_customers else F.countDistinct
    return fact.groupBy(*series_key, "order_date").agg(
        F.round(F.sum("order_value"), 2).cast("double").alias("daily_revenue"),
        F.count("order_id").alias("order_count"),
        mean(F.col("order_value")).alias("avg_order_value"),
        mean(F.col("freight_value")).alias("avg_freight"),
        distinct("customer_id").alias("unique_customers"),
    )


def build_daily_kpis(
    fact: DataFrame, series_key: Sequence[str] = (), threshold: float = 2.5, approx_customers: bool = False
) -> DataFrame:
    """Daily totals with a z-score per series. Revenue is rounded before, and z before the flag is taken."""
    daily = daily_totals(fact, series_key, approx_customers).withColumn(
        "z_score", F.round(zscore("daily_revenue", series_key), 3)
    )
    flag = F.coalesce(F.abs("z_score") > threshold, F.lit(False)).cast("int")
    return daily.withColumn("anomaly_flag", flag)


def label_ground_truth(daily: DataFrame, calendar: DataFrame, extreme: float = 3.5) -> DataFrame:
    """Marks calendar days, then days beyond ``extreme`` that the calendar does not know."""
    events = calendar.select(F.col("event_date").alias("order_date"), "label")
    outlier = F.coalesce(F.abs("z_score") > extreme, F.lit(False))
    return (
        daily.join(events, "order_date", "left")
        .withColumns(
            {
                "is_true_anomaly": (F.col("label").isNotNull() | outlier).cast("int"),
                "event_label": F.coalesce(
                    F.col("label"), F.when(outlier, "Extreme statistical outlier"), F.lit("")
                ),
            }
        )
        .drop("label")
    )


def ground_truth(labelled: DataFrame, calendar: DataFrame) -> DataFrame:
    """Labelled days with type (calendar, else sign of z) and severity (calendar, else high)."""
    events = calendar.select(F.col("event_date").alias("order_date"), "type", "severity")
    by_sign = F.when(F.col("z_score") > 0, "spike").otherwise("drop")
    return (
        labelled.filter(F.col("is_true_anomaly") == 1)
        .join(events, "order_date", "left")
        .select(
            F.col("order_date").alias("anomaly_date"),
            "event_label",
            F.coalesce("type", by_sign).alias("anomaly_type"),
            F.coalesce("severity", F.lit("high")).alias("severity"),
        )
    )


def rolling_baseline(daily: DataFrame, value: str, days: int = 90, series_key: Sequence[str] = ()) -> DataFrame:
    """Mean (four digits) and deviation of a money KPI over the last ``days`` calendar days, per series; days without
    a row are absent from the mean."""
    w = (
        Window.partitionBy(*series_key)
        .orderBy(F.unix_date("order_date"))
        .rangeBetween(-(days - 1), Window.currentRow)
    )
    return daily.select(
        *series_key,
        "order_date",
        value,
        ratio(F.sum(money(value)).over(w), F.count(value).over(w), 4).alias("baseline_mean"),
        F.stddev_samp(value).over(w).alias("baseline_std"),
        F.count(value).over(w).alias("baseline_days"),
    )


def seasonal_zscore(daily: DataFrame, value: str, series_key: Sequence[str] = ()) -> DataFrame:
    """z-score against the days of the same month of the year."""
    month = daily.withColumn("month_num", F.date_format("order_date", "MM"))
    return month.withColumn("seasonal_z", zscore(value, (*series_key, "month_num")))
