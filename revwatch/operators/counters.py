"""Run counters of a star-schema build, taken by the jobs that write its tables: no table is scanned for them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revwatch.operators.star import VALID_STATUSES

EXTREME = "Extreme statistical outlier"


class BuildCounters:
    """Observations on the frames of one build. A frame is wrapped before it is written, and its counters are there once the
    write has ended; a frame that is computed twice, or read by another job before, would count for that job."""

    def __init__(self):
        self._taken: list[Observation] = []

    def _observe(self, df: DataFrame, name: str, *metrics: Column) -> DataFrame:
        seen = Observation(name)
        self._taken.append(seen)
        return df.observe(seen, *metrics)

    def orders(self, orders: DataFrame) -> DataFrame:
        """Orders of accepted statuses and all others, as they are read."""
        kept = F.count_if(F.col("order_status").isin(*VALID_STATUSES))
        return self._observe(orders, "orders", kept.alias("orders_kept"), (F.count(F.lit(1)) - kept).alias("orders_removed"))

    def facts(self, facts: DataFrame) -> DataFrame:
        """Facts of accepted statuses, and the days from the first to the last of them."""
        accepted = F.col("order_status").isin(*VALID_STATUSES)
        date = F.when(accepted, F.col("order_date"))
        span = F.datediff(F.max(date), F.min(date)).cast("bigint")
        return self._observe(facts, "facts", F.count_if(accepted).alias("fact_orders"), span.alias("date_span_days"))

    def products(self, products: DataFrame) -> DataFrame:
        """Products and their categories; the set of categories is as large as the catalogue of categories."""
        categories = F.size(F.collect_set("category")).cast("bigint")
        return self._observe(products, "products", F.count(F.lit(1)).alias("products"), categories.alias("product_categories"))

    def days(self, labelled: DataFrame) -> DataFrame:
        """Days, flagged and labelled ones, those beyond the extreme threshold, and those of the calendar."""
        extreme = F.col("event_label") == EXTREME
        return self._observe(
            labelled,
            "days",
            F.count(F.lit(1)).alias("days"),
            F.sum(F.col("anomaly_flag").cast("bigint")).alias("flagged_days"),
            F.sum(F.col("is_true_anomaly").cast("bigint")).alias("labelled_days"),
            F.count_if(extreme).alias("extreme_days"),
            F.count_if((F.col("is_true_anomaly") == 1) & ~extreme).alias("calendar_days"),
        )

    def rows(self, spark: SparkSession) -> DataFrame:
        """(metric, value) of everything that was observed; waits for writes that have not ended."""
        found = [(name, value) for seen in self._taken for name, value in seen.get.items()]
        return spark.createDataFrame(found, "metric string, value bigint")
