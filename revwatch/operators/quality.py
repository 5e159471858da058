"""Data-quality checks, as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.functions.numeric import mean
from revwatch.functions.subquery import only_row
from revwatch.operators.global_order import exact_quantiles, exact_quantiles_by
from revwatch.operators.star import orphan_customers


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "check", "value")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with ``copies``.

    Only 8-byte row hashes are grouped over the whole table; whole rows are compared where a hash repeats.
    """
    hashed = df.withColumn("row_hash", F.xxhash64(*df.columns))
    repeated = hashed.groupBy("row_hash").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("row_hash")
    return (
        hashed.join(repeated, "row_hash", "left_semi")
        .groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def dq_report(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Nulls per column, duplicate rows, non-positive values, date range, orphan customers and rows above the 99th
    percentile, as (check, value)."""
    days = F.unix_date("order_date").cast("bigint")
    scan = fact.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in fact.columns],
        F.count_if(F.col("order_value") <= 0).alias("non_positive_order_value"),
        F.min(days).alias("first_day"),
        F.max(days).alias("last_day"),
    )
    duplicates = duplicate_rows(fact).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))
    orphans = orphan_customers(fact, dim_customers).agg(F.count("*").alias("orphan_customers"))
    limit = only_row(exact_quantiles(fact, "order_value", [0.99]))["q99"]
    extreme = fact.filter(F.col("order_value").cast("double") > limit).agg(F.count("*").alias("rows_above_p99"))
    return _long(scan).unionByName(_long(duplicates)).unionByName(_long(orphans)).unionByName(_long(extreme))


def dq_rules(tables: Mapping[str, DataFrame], min_rows: Mapping[str, int]) -> DataFrame:
    """Assertions as (check, violations): no negative order value, no empty table, row-count floors, unique order ids."""
    fact = tables["fact_orders"]
    checks = [
        fact.agg(F.count_if(F.col("order_value") < 0).alias("violations")).withColumn(
            "check", F.lit("negative_order_value")
        ),
        fact.groupBy("order_id")
        .agg(F.count("*").alias("copies"))
        .agg(F.count_if(F.col("copies") > 1).alias("violations"))
        .withColumn("check", F.lit("duplicate_order_id")),
    ]
    for name, df in tables.items():
        floor = min_rows.get(name, 1)
        checks.append(
            df.agg(F.greatest(F.lit(floor) - F.count("*"), F.lit(0)).alias("violations")).withColumn(
                "check", F.lit(f"rows_missing_{name}")
            )
        )
    out = checks[0]
    for frame in checks[1:]:
        out = out.unionByName(frame)
    return out.select("check", F.col("violations").cast("bigint").alias("violations"))


def describe(df: DataFrame, columns) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of each column, one row per column, from one stacked scan."""
    long = df.select(*[F.col(c).cast("decimal(18,2)").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    value = F.col("v").cast("double")
    scan = long.groupBy("column").agg(
        F.count("v").alias("count"),
        mean(F.col("v"), 4).alias("mean"),
        F.round(F.stddev_samp(value), 4).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    cuts = exact_quantiles_by(long, ["column"], "v", [0.25, 0.5, 0.75])
    quartiles = [F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")]
    return scan.join(cuts, "column").select("column", "count", "mean", "stddev", "min", *quartiles, "max")
