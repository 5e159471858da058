"""Table and CSV sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.functions.numeric import publish
from revwatch.sources import schemas


def write_table(df: DataFrame, path: str, month_of: str | None = None) -> DataFrame:
    """Overwrite one parquet table, partitioned by the month of ``month_of`` when given; returns the table read back."""
    out = df
    if month_of:
        # One shuffle on the month keeps the file count at one set per month; AQE splits a month that is too large.
        out = df.withColumn("month", F.date_format(month_of, "yyyy-MM")).hint("rebalance", "month")
        out.write.mode("overwrite").partitionBy("month").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Replace every result table under ``root``; frames with an ``order_date`` are partitioned by month."""
    return {
        name: write_table(df, f"{root}/{name}", "order_date" if "order_date" in df.columns else None)
        for name, df in tables.items()
    }


def save_as_tables(
    tables: Mapping[str, DataFrame],
    database: str = "default",
    bucket_by: Mapping[str, str] | None = None,
    buckets: int = 200,
) -> None:
    """Replace catalog tables. Tables bucketed on the same key with the same count join and group without a shuffle."""
    bucket_by = bucket_by or {}
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if name in bucket_by:
            key = bucket_by[name]
            # One task per bucket, so that each bucket is one sorted file.
            writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def write_csv(df: DataFrame, path: str) -> None:
    publish(df).write.mode("overwrite").option("header", True).csv(path)


def read_model_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_RESULTS).option("header", True).csv(path)


def read_ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUND_TRUTH).option("header", True).csv(path)
