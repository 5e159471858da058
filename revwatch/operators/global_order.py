"""Ranks, running sums and exact quantiles over a whole table without a one-partition window.

The table is range-partitioned on the sort key, each slab is ranked on its own, and the slab totals (one row per
range partition) give every slab its offset. Ties are split by the last sort column, so one value held by many rows
still spreads over many slabs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.session import materialize


def rank_globally(df: DataFrame, order_by: Sequence[Column], running: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``position`` (1-based), ``n_total``, and for each running column ``name`` and ``name_total``.

    ``df`` is read twice, first for a sample of the sort key: an aggregation should be a written table.
    """
    running = dict(running or {})
    slabs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id counts rows within a sorted partition and carries the partition number above bit 33.
    row_id = F.monotonically_increasing_id()
    ranked = (
        df.repartitionByRange(slabs, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("row_id", row_id)
        .withColumns(
            {
                "slab": F.shiftright("row_id", 33).cast("int"),
                "slab_position": F.col("row_id").bitwiseAND((1 << 33) - 1) + 1,
            }
        )
        .drop("row_id")
    )
    if running:
        upto = Window.partitionBy("slab").orderBy("slab_position").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.withColumns(
            {f"part_{name}": col for name, col in running.items()}
            | {f"slab_{name}": F.sum(col).over(upto) for name, col in running.items()}
        )
    # Range bounds are sampled per run; the written table pins which slab each row belongs to.
    ranked = materialize(ranked, "ranked")
    before = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranked.groupBy("slab").agg(
        F.count("*").alias("rows"), *[F.sum(f"part_{name}").alias(f"sum_{name}") for name in running]
    )
    offsets = totals.select(
        "slab",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("rows").over(everything).alias("n_total"),
        *[F.sum(f"sum_{name}").over(before).alias(f"before_{name}") for name in running],
        *[F.sum(f"sum_{name}").over(everything).alias(f"{name}_total") for name in running],
    )
    joined = ranked.join(F.broadcast(offsets), "slab")  # one row per range partition
    return joined.select(
        *df.columns,
        (F.col("slab_position") + F.col("rows_before")).alias("position"),
        "n_total",
        *[
            _plus(F.col(f"slab_{name}"), F.col(f"before_{name}")).alias(name)
            for name in running
        ],
        *[f"{name}_total" for name in running],
    )


def _plus(own: Column, before: Column) -> Column:
    """Sum of a slab's running sum and that of the slabs before it; NULL only while no value has been seen."""
    return F.when(own.isNull(), before).when(before.isNull(), own).otherwise(own + before)


def ntile(buckets: int) -> Column:
    """SQL NTILE from ``position`` and ``n_total``: the first ``n % buckets`` tiles hold one more row."""
    n, r, k = F.col("n_total"), F.col("position") - 1, F.lit(buckets)
    size, extra = F.floor(n / k), n % k
    head = extra * (size + 1)
    tile = F.when(r < head, F.floor(r / (size + 1)) + 1).otherwise(
        F.floor((r - head) / F.greatest(size, F.lit(1))) + extra + 1
    )
    return tile.cast("bigint")


def quantile_name(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


def _value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts in running order, so that quantiles shuffle (value, count) pairs, not rows."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    counts = materialize(counts, "value_counts")  # range partitioning reads its input twice: to sample it, then to deal it
    return rank_globally(counts, [*[F.col(k) for k in keys], F.col("v")], {"upto": F.col("c")})


def _brackets(probs: Sequence[float], n: Column, before: Column) -> list[Column]:
    """The two values around every quantile position, as aggregates over running counts."""
    out = []
    for p in probs:
        at = (n - 1) * F.lit(p)
        for part, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("upto") - F.col("c") - before <= index) & (index < F.col("upto") - before)
            out.append(F.max(F.when(holds, F.col("v").cast("double"))).alias(f"{quantile_name(p)}_{part}"))
    return out


def _interpolated(probs: Sequence[float]) -> list[Column]:
    out = []
    for p in probs:
        name, at = quantile_name(p), (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with the linearly interpolated quantiles of ``value``, named q25, q75, ..."""
    ranked = _value_counts(df, (), value)
    row = ranked.agg(F.max("upto_total").alias("n"), *_brackets(probs, F.col("upto_total"), F.lit(0)))
    return row.select(*_interpolated(probs))


def exact_quantiles_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles per key. A key's values may span many range partitions, so no key is held by one task."""
    ranked = _value_counts(df, keys, value)
    groups = ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("rows_before")
    )
    return (
        ranked.join(groups, list(keys))
        .groupBy(*keys, "n")
        .agg(*_brackets(probs, F.col("n"), F.col("rows_before")))
        .select(*keys, *_interpolated(probs))
    )
