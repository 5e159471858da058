"""Daily KPIs, alerts and exponentially weighted z-scores over streams.

These extend the batch operators to the daily monitoring the project describes; each has a batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revwatch.functions.labels import z_label
from revwatch.functions.numeric import MONEY, mean, safe_divide
from revwatch.session import fresh_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def read_event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int = 64) -> DataFrame:
    """Event files as a stream; the wall-clock timestamp is read as UTC, since watermarks need an instant."""
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def drain(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Process everything available into a parquet table in the shared folder and return that table.

    ``root`` names the folder of data and progress, with which a later call goes on where the earlier one ended.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/data")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def drain_updates(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Process everything available in update mode and return the newest row of every key, closed by a watermark or not.

    Each micro-batch overwrites a folder of its own, so a batch that is run again after a failure counts once.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    seen = spark.read.schema(batches).parquet(f"{root}/data")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return seen.withColumn("age", F.row_number().over(newest)).filter("age = 1").select(*stream.columns)


def _day_aggregates() -> list[Column]:
    amount = F.col("value").cast(MONEY)
    return [
        F.sum(amount).cast("double").alias("daily_value"),
        F.count("*").alias("event_count"),
        mean(amount).alias("avg_value"),
    ]


def stream_daily_kpis(events: DataFrame, series_key: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Daily totals per series, emitted once the watermark closes the day; later rows are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), *series_key)
        .agg(*_day_aggregates(), F.approx_count_distinct("user_id").alias("approx_users"))
        .select(
            *series_key,
            F.to_date("window.start").alias("order_date"),
            "daily_value",
            "event_count",
            "avg_value",
            "approx_users",
        )
    )


def events_daily_kpis(events: DataFrame, series_key: Sequence[str]) -> DataFrame:
    """Batch twin of ``stream_daily_kpis`` with exact distinct users."""
    return (
        events.withColumn("order_date", F.to_date("ts"))
        .groupBy(*series_key, "order_date")
        .agg(*_day_aggregates(), F.countDistinct("user_id").alias("unique_users"))
    )


def value_baseline(history: DataFrame, series_key: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation per series."""
    return history.groupBy(*series_key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def alerts(
    events: DataFrame,
    baseline: DataFrame,
    series_key: Sequence[str],
    whitelist: DataFrame | None = None,
    value: str = "value",
    threshold: float = 2.5,
) -> DataFrame:
    """Rows beyond ``threshold`` deviations of the baseline; days of ``whitelist`` never alert.

    ``events`` may be a stream or a table. The baseline, one row per series, is looked up; Spark broadcasts it as long as
    its measured size allows.
    """
    z = F.round(safe_divide(F.col(value) - F.col("mean"), F.col("std")), 6)
    quiet = events.withColumn("order_date", F.to_date("ts"))
    if whitelist is not None:
        days = whitelist.select(F.col("event_date").alias("order_date"))
        quiet = quiet.join(days, "order_date", "left_anti")
    return (
        quiet.join(baseline, list(series_key))
        .withColumn("z_score", z)
        .filter(F.abs("z_score") > threshold)
        .drop("mean", "std")
        .withColumn("alert", z_label(F.col("z_score"), threshold))
    )


def stream_ewm(days: DataFrame, key: str, value: str, span: int = 7) -> DataFrame:
    """Exponentially weighted |z| per series over a stream of daily rows.

    State per series is the weight sums and the weighted first two moments about its first value. Rows are ordered
    within a micro-batch; a day at or before the last one seen is late and is dropped.
    """
    decay = 1 - 2 / (span + 1)
    schema = T.StructType(
        [
            days.schema[key],
            T.StructField("order_date", T.DateType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    state_schema = "last int, shift double, w double, w2 double, wx double, wxx double"
    epoch = pd.Timestamp("1970-01-01")

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("order_date")
        last, shift, w, w2, wx, wxx = state.get if state.exists else (None, float(pdf[value].iloc[0]), 0.0, 0.0, 0.0, 0.0)
        out = []
        for date, x in zip(pdf["order_date"], pdf[value]):
            day = (pd.Timestamp(date) - epoch).days
            if last is not None and day <= last:
                continue
            last, y = day, x - shift
            w, w2 = w * decay + 1, w2 * decay * decay + 1
            wx, wxx = wx * decay + y, wxx * decay + y * y
            centre = wx / w
            spare = w * w - w2
            spread = (max(wxx / w - centre * centre, 0.0) * w * w / spare) ** 0.5 if spare > 1e-12 else 1.0
            out.append((keys[0], date, abs((y - centre) / spread) if spread > 0 else 0.0))
        if last is not None:
            state.update((last, shift, w, w2, wx, wxx))
        yield pd.DataFrame(out, columns=schema.names)

    return (
        days.select(key, "order_date", value)
        .groupBy(key)
        .applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
    )
