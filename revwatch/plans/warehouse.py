"""Derived tables of one dataset, each written once per application and shared by the queries that read it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.operators import grid, kpis, sketches, star
from revwatch.operators.calendar import calendar_years, holiday_calendar
from revwatch.operators.counters import BuildCounters
from revwatch.operators.detectors import density, isolation
from revwatch.operators.features import FEATURE_SETS, build_features, feature_vectors
from revwatch.session import intermediates, materialize
from revwatch.sources.tables import Sources, from_wholesale, read_parquet


class Warehouse:
    """Star schema, KPI series and grid results of one directory of wholesale tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.counters = BuildCounters()

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Writes a shared table; what its operators write on the way is dropped as soon as it stands."""
        with intermediates(self.spark):
            return materialize(build(), name, keep=True)

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.sf_dir, name)

    @cached_property
    def sources(self) -> Sources:
        return from_wholesale(self.spark, self.sf_dir)

    @cached_property
    def valid_sources(self) -> Sources:
        """Sources restricted at the scan to the statuses that count as revenue."""
        return from_wholesale(self.spark, self.sf_dir, star.VALID_STATUSES)

    @cached_property
    def calendar(self) -> DataFrame:
        """Labelled days of all years in which there are orders."""
        return holiday_calendar(self.spark, *calendar_years(self.sources.orders, "order_date"))

    @cached_property
    def fact_orders_all(self) -> DataFrame:
        s, seen = self.sources, self.counters
        return self.keep(
            "fact_orders_all", lambda: seen.facts(star.fact_orders_all(seen.orders(s.orders), s.items, s.customers))
        )

    @property
    def fact_orders(self) -> DataFrame:
        return star.valid_orders(self.fact_orders_all)

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return self.keep("fact_order_items", lambda: star.fact_order_items(self.sources.orders, self.sources.items))

    @cached_property
    def dim_customers(self) -> DataFrame:
        return self.keep("dim_customers", lambda: star.build_dim_customers(self.fact_orders))

    @cached_property
    def dim_products(self) -> DataFrame:
        s = self.sources
        return self.keep("dim_products", lambda: self.counters.products(star.build_dim_products(s.items, s.products)))

    @cached_property
    def daily_kpis(self) -> DataFrame:
        daily = kpis.build_daily_kpis(self.fact_orders)
        return self.keep("daily_kpis", lambda: self.counters.days(kpis.label_ground_truth(daily, self.calendar)))

    def build_metrics(self) -> DataFrame:
        """Counters of the writes of the star schema; tables that do not stand yet are written."""
        _ = self.fact_orders_all, self.dim_products, self.daily_kpis
        return self.counters.rows(self.spark)

    @cached_property
    def order_value_sketches(self) -> DataFrame:
        """A quantile sketch of order values per day and state."""
        keys = ["order_date", "customer_state"]
        return self.keep("value_sketches", lambda: sketches.quantile_sketches(self.fact_orders, keys, "order_value"))

    @cached_property
    def customer_sketches(self) -> DataFrame:
        """A distinct sketch of customers per day."""
        return self.keep(
            "customer_sketches", lambda: sketches.distinct_sketches(self.fact_orders, ["order_date"], "customer_id")
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.keep("features", lambda: build_features(self.daily_kpis))

    @cached_property
    def _family_results(self) -> dict[str, DataFrame]:
        return {}

    def grid_family(self, name: str) -> DataFrame:
        done = self._family_results
        if name not in done:
            done[name] = self.keep(f"grid_{name}", lambda: grid.ALL_FAMILIES[name](self.features))
        return done[name]

    def _results(self, families) -> DataFrame:
        """Families are independent jobs with idle tails, so they are submitted together."""
        _ = self.features, self._family_results  # built before the jobs that share them start
        with ThreadPoolExecutor(len(families)) as pool:
            frames = list(pool.map(inheritable_thread_target(self.spark)(self.grid_family), families))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    @cached_property
    def model_results(self) -> DataFrame:
        """Grid results of all families but the iterative seasonal decomposition, as one table for all its readers."""
        families = self._results(grid.DEFAULT_FAMILIES)
        return self.keep("model_results", lambda: families.coalesce(1))  # a few thousand short rows

    @cached_property
    def model_results_all(self) -> DataFrame:
        """The seven-family grid, 2,327 configurations."""
        return self._results(tuple(grid.GRID_FAMILIES))

    def _vectors(self, feature_set: str) -> DataFrame:
        return feature_vectors(self.features, (), {feature_set: FEATURE_SETS[feature_set]})

    @cached_property
    def lof_scores(self) -> DataFrame:
        """Local outlier factor (k 20) of every day on the combined feature set."""
        return self.keep("lof_scores", lambda: density.lof_scores(self._vectors("multi_feature"), (), [20]))

    @cached_property
    def forest_scores(self) -> DataFrame:
        """Isolation forest (200 trees, all columns) of every day on the combined feature set."""
        return self.keep(
            "forest_scores", lambda: isolation.isolation_scores(self._vectors("multi_feature"), (), [1.0], [200])
        )

    @cached_property
    def category_values(self) -> DataFrame:
        """Value and freight per (order, category, status), which the category reports share."""
        return self.keep(
            "category_values",
            lambda: star.order_attribute_values(self.fact_order_items, self.sources.products, F.col("category")),
        )


_OPEN: dict[tuple[str, str], Warehouse] = {}


def open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Warehouse(spark, sf_dir)
    return _OPEN[key]
