"""Points of one series packed into blocks of fixed size, and the block pairs a distance question needs.

Blocks come from equal-count cuts along the first dimensions, so they hold about ``BLOCK_POINTS`` points however dense
a region is. A pair of blocks is formed only when their bounding boxes are close enough to matter, and each pair is its
own unit of work, so neither a hot cell nor a long series lands in one task. Pairs of points never become rows; pairs of
blocks number (days / 1,024)² per series at most, and a series has one point per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_POINTS = 1024
SPLIT_DIMS = 3
DISTANCE_DIGITS = 9


def to_blocks(vectors: DataFrame, keys: Sequence[str], dims: int, payload: str | None = None) -> DataFrame:
    """One row per block: ``days`` and flat ``vecs`` (and flat ``payload``) in date order, with the bounding box."""
    split = vectors.withColumn("block", F.lit(0).cast("bigint"))
    used = F.least(F.size("vec"), F.lit(SPLIT_DIMS))
    whole = Window.partitionBy(*keys)
    parts = F.ceil(F.pow(F.count("*").over(whole) / BLOCK_POINTS, F.lit(1.0) / used))
    split = split.withColumn("parts", parts)
    for i in range(min(SPLIT_DIMS, dims)):
        # Cut every block into ``parts`` of equal count along dimension i; a vector without it stays whole.
        within = Window.partitionBy(*keys, "block")
        rank = F.row_number().over(within.orderBy(F.get("vec", F.lit(i)), "order_date")) - 1
        cut = F.when(F.size("vec") > i, F.floor(rank * F.col("parts") / F.count("*").over(within))).otherwise(0)
        split = split.withColumn("cut", cut).withColumn("block", F.col("block") * F.col("parts") + F.col("cut"))
    member = F.struct(F.unix_date("order_date").alias("day"), "vec", *([payload] if payload else []))
    boxed = (
        split.groupBy(*keys, "block")
        .agg(
            F.sort_array(F.collect_list(member)).alias("members"),
            F.array(*[F.min(F.get("vec", F.lit(i))) for i in range(dims)]).alias("low"),
            F.array(*[F.max(F.get("vec", F.lit(i))) for i in range(dims)]).alias("high"),
        )
    )
    return boxed.select(
        *keys,
        "block",
        F.col("members.day").alias("days"),
        F.flatten(F.col("members.vec")).alias("vecs"),
        *([F.flatten(F.col(f"members.{payload}")).alias(payload)] if payload else []),
        "low",
        "high",
    )


def box_gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Smallest possible distance between points of two bounding boxes."""

    def gap(low: Column, high: Column) -> Column:
        return F.coalesce(F.greatest(low - high, F.lit(0.0)), F.lit(0.0))

    above = F.zip_with(low_a, high_b, gap)
    below = F.zip_with(low_b, high_a, gap)
    squares = F.zip_with(above, below, lambda x, y: x * x + y * y)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def block_pairs(blocks: DataFrame, keys: Sequence[str], reach: Column) -> DataFrame:
    """Ordered block pairs of one key whose boxes are within ``reach``; b's columns carry the suffix ``_b``.

    ``blocks`` should be a written table: both sides of the join read it.
    """
    other = blocks.select(*keys, *[F.col(c).alias(f"{c}_b") for c in blocks.columns if c not in (*keys, "radius")])
    # The margin keeps pairs whose distance only reaches the limit after rounding.
    close = box_gap("low", "high", "low_b", "high_b") <= reach + F.lit(1e-6)
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        blocks.join(other, list(keys))
        .filter(close)
        .drop("low", "high", "low_b", "high_b", "radius")
        .repartition(partitions, *keys, "block", "block_b")
    )


def distances(vecs_a: np.ndarray, n_a: int, vecs_b: np.ndarray, n_b: int) -> np.ndarray:
    a = np.asarray(vecs_a, float).reshape(n_a, -1)
    b = np.asarray(vecs_b, float).reshape(n_b, -1)
    total = np.zeros((n_a, n_b))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.round(np.sqrt(total), DISTANCE_DIGITS)
