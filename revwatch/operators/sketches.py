"""Mergeable sketches of daily KPIs: quantiles (KLL) and distinct counts (HLL) for any period without another scan.

A day's sketch is built once; months, weeks and the whole time are unions of stored sketches, each a few kilobytes whatever
the number of rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch; the rank error falls about as fast as this grows.
KLL_K = 800
#: Binary logarithm of the number of registers of a distinct sketch.
HLL_LG = 14


def rank_error(k: int = KLL_K) -> float:
    """Share of rows by which a quantile may miss its rank, at 99 % confidence: the error that the sketch documents."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = HLL_LG) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / 2 ** (lg / 2)


def quantile_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """(keys, n, sketch): one sketch of ``value`` per key. Null values are left out; a key with none has no row."""
    kept = rows.filter(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    )


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], k: int = KLL_K) -> DataFrame:
    """(keys, n, sketch) of coarser keys, from sketches alone; no key merges everything."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def read_quantiles(sketches: DataFrame, keys: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """(keys, n, rank, estimate): the value at each rank of every sketch."""
    points = [
        F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("estimate"))
        for r in ranks
    ]
    return sketches.select(*keys, "n", F.explode(F.array(*points)).alias("p")).select(*keys, "n", "p.rank", "p.estimate")


def rank_misses(rows: DataFrame, keys: Sequence[str], value: str, quantiles: DataFrame) -> DataFrame:
    """(keys, rank, miss): how far, as a share of rows, each estimate's true rank lies from the one asked for.

    ``quantiles`` holds few rows per key, so the rows meet the estimates of their key as one array, in one pass.
    """
    asked = quantiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "estimate"))).alias("points"))
    kept = rows.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    flat = kept.join(asked, list(keys)).select(*keys, "_v", F.explode("points").alias("p"))
    counts = flat.groupBy(*keys, F.col("p.rank").alias("rank")).agg(
        F.avg((F.col("_v") < F.col("p.estimate")).cast("int")).alias("below"),
        F.avg((F.col("_v") <= F.col("p.estimate")).cast("int")).alias("up_to"),
    )
    miss = F.greatest(F.col("below") - F.col("rank"), F.col("rank") - F.col("up_to"), F.lit(0.0))
    return counts.select(*keys, "rank", miss.alias("miss"))


def distinct_sketches(rows: DataFrame, keys: Sequence[str | Column], value: str, lg: int = HLL_LG) -> DataFrame:
    """(keys, sketch): one distinct sketch per key, over a table or a stream."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), F.lit(lg)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """(keys, estimate): distinct values of coarser keys, from sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def close_to(estimate: Column, exact: Column, lg: int = HLL_LG, sigmas: int = 4) -> Column:
    """Whether an estimate lies within so many standard errors of the exact count, or within one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (sigmas * distinct_error(lg)))
