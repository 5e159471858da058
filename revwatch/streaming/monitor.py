"""Alerts over a stream against a baseline that is refreshed while the stream runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.operators.baselines import alerts_as_of
from revwatch.session import fresh_path


def drain_alerts(
    events: DataFrame,
    versions: Callable[[], DataFrame],
    series_key: Sequence[str],
    value: str,
    date: Column,
    whitelist: DataFrame | None = None,
    threshold: float = 2.5,
    root: str | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Processes everything available; every micro-batch reads the baseline anew and writes a folder of its own.

    ``versions`` is asked once per micro-batch, so a refresh between two of them is seen by the second, and a batch that is
    run again after a failure counts once. ``root`` names the folder of data and progress, with which a later call goes on.
    """
    spark = events.sparkSession
    root = root or fresh_path(spark, "alerts")

    def judge(batch: DataFrame, number: int) -> None:
        found = alerts_as_of(batch, versions(), series_key, value, date, whitelist, threshold)
        found.select(*(columns or found.columns)).write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    query = (
        events.writeStream.foreachBatch(judge)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _read(spark, f"{root}/data")


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")
