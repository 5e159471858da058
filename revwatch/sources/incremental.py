"""Re-runs that write only the months that changed, found by an order-independent digest per month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.session import drop_path

DIGESTS = "month string, rows bigint, digest decimal(38,0)"


def month_digests(df: DataFrame, month: str = "month") -> DataFrame:
    """(month, rows, digest): two tables with the same rows have the same digests, whatever the order and the files.

    Rows are hashed to 64 bits each, doubles bit by bit, and added up, so one pass with partial sums does it.
    """
    columns = [F.col(c) for c in sorted(df.columns) if c != month]
    return df.groupBy(month).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    """The digests of the last complete run; empty before the first."""
    if not _exists(spark, f"{path}/digests/_SUCCESS"):
        return spark.createDataFrame([], DIGESTS)
    return spark.read.schema(DIGESTS).parquet(f"{path}/digests")


def write_changed_months(df: DataFrame, path: str, date: str) -> list[str]:
    """Brings the table at ``path/data``, partitioned by the month of ``date``, up to ``df``; returns the months it wrote.

    Months whose digest is as stored are left alone, months that are gone are dropped, and the others are replaced by a
    dynamic partition overwrite. The digests are stored last: a run that failed half way is simply done again. Months are
    as many as the calendar has, so their names pass through the driver. Rows without a date share the month ``none``.
    """
    spark = df.sparkSession
    dated = df.withColumn("month", F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none")))
    fresh = {r["month"]: (r["rows"], r["digest"]) for r in month_digests(dated).collect()}
    known = {r["month"]: (r["rows"], r["digest"]) for r in stored_digests(spark, path).collect()}
    changed = sorted(m for m, state in fresh.items() if known.get(m) != state)
    if changed:
        # Only these months are computed and shuffled; the filter reaches the scan where the date is a stored column.
        rows = dated.filter(F.col("month").isin(changed)).hint("rebalance", "month")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/data")
    for month in known.keys() - fresh.keys():
        drop_path(spark, f"{path}/data/month={month}")
    if changed or known.keys() - fresh.keys():
        state = [(m, *s) for m, s in sorted(fresh.items())]
        spark.createDataFrame(state, DIGESTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")
    return changed


def read_months(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as it stands, with its month."""
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, month string").parquet(
        f"{path}/data"
    )


def register_months(spark: SparkSession, database: str, name: str, path: str, like: DataFrame) -> None:
    """Names the table in the catalog and lists its partitions there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, month STRING) USING parquet PARTITIONED BY (month) "
        f"LOCATION '{path}/data'"
    )
    spark.catalog.recoverPartitions(f"{database}.{name}")


def table_listing(spark: SparkSession, database: str, names: Sequence[str] = ()) -> DataFrame:
    """(table_name, columns, partitions) of the tables of a database, from the catalog alone."""
    found = []
    for table in spark.catalog.listTables(database):
        if names and table.name not in names:
            continue
        columns = spark.catalog.listColumns(f"{database}.{table.name}")
        parted = any(c.isPartition for c in columns)
        partitions = spark.sql(f"SHOW PARTITIONS {database}.{table.name}").count() if parted else 0
        found.append((table.name, len(columns), partitions))
    return spark.createDataFrame(found, "table_name string, columns bigint, partitions bigint")
