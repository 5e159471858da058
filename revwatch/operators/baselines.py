"""Versioned baselines: the mean and deviation of the last days before every refresh, each valid until the next one.

A row meets the version of its own day (an as-of join), so nothing that happens later can change how it was judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revwatch.functions.labels import z_label
from revwatch.functions.numeric import cents, safe_divide
from revwatch.session import drop_path, fresh_path

#: How far apart refreshes are, as an interval, and where the first one lies.
REFRESH = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def daily_moments(rows: DataFrame, value: str, series_key: Sequence[str] = (), date: str = "order_date") -> DataFrame:
    """Count, sum and sum of squares in integer cents per series and day; they add up over any days."""
    c = cents(F.col(value)).cast("decimal(19,0)")  # the square of a day's revenue is beyond a long
    return (
        rows.filter(F.col(value).isNotNull() & F.col(date).isNotNull())
        .groupBy(*series_key, F.to_date(date).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(c).cast("decimal(38,0)").alias("s"),
            F.sum(c * c).cast("decimal(38,0)").alias("q"),
        )
    )


def baseline_versions(
    moments: DataFrame, series_key: Sequence[str] = (), days: int = 90, every: str = "month"
) -> DataFrame:
    """One row per series and refresh: (valid_from, valid_to, base_rows, base_mean, base_std).

    A version looks at the ``days`` days before ``valid_from`` and never at that day or a later one. It holds until the
    next refresh; the last one of a series expires ``days`` days after it was made. Versions without two rows behind
    them are left out. ``moments`` are the rows of ``daily_moments``.
    """
    step = F.expr(REFRESH[every])
    spans = moments.groupBy(*series_key).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    dates = F.sequence(F.trunc("first", every) if every != "day" else F.col("first"), F.date_add("last", 1), step)
    zero = F.lit(0).cast("decimal(38,0)")
    refreshes = spans.select(
        *series_key, F.explode(dates).alias("day"), F.lit(0).cast("bigint").alias("n"), zero.alias("s"), zero.alias("q"),
        F.lit(True).alias("refresh"),
    )
    # One row per day and series: the window is bounded by the calendar.
    before = Window.partitionBy(*series_key).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    after = Window.partitionBy(*series_key).orderBy("day")
    n, s, q = (F.sum(c).over(before).cast("decimal(38,0)").alias(c) for c in ("n", "s", "q"))
    seen = moments.withColumn("refresh", F.lit(False)).unionByName(refreshes).select(*series_key, "day", "refresh", n, s, q)
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    count = F.col("n").cast("double")
    return (
        seen.filter("refresh")
        .withColumn("valid_to", F.coalesce(F.lead("day").over(after), F.date_add("day", days)))
        .filter("n >= 2")
        .select(
            *series_key,
            F.col("day").alias("valid_from"),
            "valid_to",
            F.col("n").cast("bigint").alias("base_rows"),
            (F.col("s").cast("double") / (count * 100)).alias("base_mean"),
            (F.sqrt(spread / (count * (count - 1))) / 100).alias("base_std"),
        )
    )


def as_of(rows: DataFrame, versions: DataFrame, series_key: Sequence[str], date: Column) -> DataFrame:
    """``rows`` (a table or a stream) with the version that is valid on their day; rows without one are left out.

    The join is on the series and the month, so a row meets the versions of its month alone. The versions, bounded by
    the calendar, are broadcast as far as their measured size allows, else both sides are shuffled.
    """
    last = F.date_sub("valid_to", 1)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    dealt = versions.withColumn("_month", F.explode(months))
    dated = rows.withColumn("_day", date).withColumn("_month", F.trunc("_day", "month"))
    valid = (F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to"))
    return dated.join(dealt, [*series_key, "_month"]).filter(valid).drop("_month", "_day")


def alerts_as_of(
    rows: DataFrame,
    versions: DataFrame,
    series_key: Sequence[str],
    value: str,
    date: Column,
    whitelist: DataFrame | None = None,
    threshold: float = 2.5,
) -> DataFrame:
    """Rows beyond ``threshold`` deviations of the baseline of their own day; days of ``whitelist`` never alert."""
    judged = rows
    if whitelist is not None:
        days = whitelist.select(F.col("event_date").alias("_quiet"))
        judged = judged.join(days, date == F.col("_quiet"), "left_anti")
    z = F.round(safe_divide(F.col(value) - F.col("base_mean"), F.col("base_std")), 6)
    found = as_of(judged, versions, series_key, date).withColumn("z_score", z).filter(F.abs("z_score") > threshold)
    return found.withColumn("alert", z_label(F.col("z_score"), threshold)).drop("base_rows", "base_mean", "base_std", "valid_to")


class VersionStore:
    """Baseline versions as a Parquet table, written anew at each refresh and read at each look-up.

    A refresh writes a folder of its own and then names it in a one-row pointer table, so a reader sees the versions from
    before or from after, and a refresh that failed leaves no trace. Versions that are stored stay as they are: a refresh
    only adds those of later days.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, series_key: Sequence[str] = ()):
        self.spark, self.root, self.series_key = spark, root or fresh_path(spark, "baselines"), tuple(series_key)
        self.current: DataFrame | None = None

    def refresh(self, moments: DataFrame, days: int = 90, every: str = "month") -> DataFrame:
        """Adds the versions made since the last refresh from ``moments`` of all days seen so far."""
        versions = baseline_versions(moments, self.series_key, days, every)
        stored = self.read()
        if stored is not None:
            # A stored version that was the last of its series ends where the next one begins.
            known = stored.groupBy(*self.series_key).agg(F.max("valid_from").alias("_last")) if self.series_key else None
            if known is not None:
                fresh = versions.join(known, list(self.series_key), "left").filter(
                    F.col("_last").isNull() | (F.col("valid_from") > F.col("_last"))
                )
                versions = stored.unionByName(fresh.drop("_last"))
            else:
                last = stored.agg(F.max("valid_from")).head()[0]
                versions = stored.unionByName(versions.filter(F.col("valid_from") > F.lit(last)))
            after = Window.partitionBy(*self.series_key).orderBy("valid_from")
            ends = F.least(F.col("valid_to"), F.coalesce(F.lead("valid_from").over(after), F.col("valid_to")))
            versions = versions.withColumn("valid_to", ends)
        folder = fresh_path(self.spark, "versions")
        versions.write.parquet(folder)
        before = self._folder()
        self.spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointer")
        if before is not None:
            drop_path(self.spark, before)
        return self.read()

    def _folder(self) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("folder string").parquet(f"{self.root}/pointer").head()["folder"]

    def read(self) -> DataFrame | None:
        """The versions as of now, or None before the first refresh."""
        folder = self._folder()
        return None if folder is None else self.spark.read.parquet(folder)
