"""Isolation forest (Liu, Ting and Zhou, 2008) for every feature set and column fraction at once."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hyper-parameters of the grid.
IF_CONTAMINATION = (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.08, 0.10, 0.12, 0.15)
IF_ESTIMATORS = (50, 100, 150, 200, 300)
IF_MAX_FEATURES = (0.5, 0.75, 1.0)
SAMPLE_SIZE = 256
TREES_PER_GROUP = 25
POINTS_PER_GROUP = 4096


PRIME = 2147483647
CUT_STEPS = 1 << 20
#: Features enter as integers of this many per unit, and path lengths leave as integers of this many per edge, so that
#: neither a cut nor a sum depends on the engine or on the order of the rows.
UNITS = 1_000_000


def spread(x):
    """Scatters integers over 0 .. PRIME - 1; works on numbers, arrays and Spark columns, without leaving 64 bits."""
    x = (x + 1315423911) % PRIME
    x = (x * x % PRIME * 48271 + 11) % PRIME
    return x * x % PRIME * 69621 % PRIME


def tree_draw(feature_set: str, width: int, tree: int, seed: int) -> int:
    """The number that all draws of one tree start from."""
    return spread(spread(seed + 1000 + zlib.crc32(feature_set.encode()) % 1_000_003 * 10 + width) + tree)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree over n points."""
    n = np.asarray(n, float)
    body = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, body, np.where(n == 2, 1.0, 0.0))


def leaf_path(n: np.ndarray) -> np.ndarray:
    """``average_path`` in whole ``UNITS``."""
    return np.rint(UNITS * average_path(n)).astype(np.int64)


def tree_columns(n_columns: int, width: int, draw: int) -> np.ndarray:
    """The ``width`` columns with the smallest draws."""
    order = np.argsort(spread(draw + 31 * (np.arange(n_columns, dtype=np.int64) + 1)), kind="stable")
    return np.sort(order[:width])


def tree_depths(sample: np.ndarray, points: np.ndarray, columns: np.ndarray, draw: int) -> np.ndarray:
    """Grow one random tree on ``sample`` level by level and return the path length of every point, in ``UNITS``."""
    limit = max(1, math.ceil(math.log2(max(len(sample), 2))))
    at_sample = np.zeros(len(sample), int)
    at_points = np.zeros(len(points), int)
    depth = np.zeros(len(points), np.int64)
    open_points = np.ones(len(points), bool)
    open_sample = np.ones(len(sample), bool)
    for level in range(limit):  # node numbers restart per level: children of i are 2i and 2i + 1
        nodes = 2**level
        low = np.full((nodes, len(columns)), np.iinfo(np.int64).max)
        high = np.full((nodes, len(columns)), np.iinfo(np.int64).min)
        values = sample[np.ix_(open_sample, columns)]
        np.minimum.at(low, at_sample[open_sample], values)
        np.maximum.at(high, at_sample[open_sample], values)
        splittable = high > low
        # A random column among those that still vary in the node.
        rows = np.arange(nodes, dtype=np.int64)
        number = draw + 4099 * (rows + nodes)
        drawn = spread(number[:, None] + 31 * (columns + 1)[None, :] + 17)
        choice = np.where(splittable, drawn, -1).argmax(axis=1)
        splits = splittable.any(axis=1)
        start = np.where(splits, low[rows, choice], 0)
        width = np.where(splits, high[rows, choice], 0) - start
        cut = start + width * (spread(number + 7) % CUT_STEPS) // CUT_STEPS
        column = columns[choice]

        closing = open_points & ~splits[at_points]
        sizes = np.bincount(at_sample[open_sample], minlength=nodes)
        depth[closing] = level * UNITS + leaf_path(sizes[at_points[closing]])
        open_points &= splits[at_points]
        open_sample &= splits[at_sample]
        for at, data, is_open in ((at_points, points, open_points), (at_sample, sample, open_sample)):
            node = at[is_open]
            right = data[is_open, column[node]] > cut[node]
            at[is_open] = 2 * node + right
    sizes = np.bincount(at_sample[open_sample], minlength=2**limit)
    depth[open_points] = limit * UNITS + leaf_path(sizes[at_points[open_points]])
    return depth


def draw_samples(days: DataFrame, series_key: Sequence[str], n_trees: int, seed: int) -> DataFrame:
    """Per tree the ``SAMPLE_SIZE`` days with the smallest hashes; a threshold on the hash first drops most others."""
    key = list(series_key)
    draw = spread(spread(F.col("tree").cast("bigint") + seed) + F.unix_date("order_date"))
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_SIZE) / F.col("n"))
    rank = Window.partitionBy(*key, "tree").orderBy("draw", "order_date")
    return (
        days.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
        .withColumn("draw", draw)
        .filter(F.col("draw") < share * F.lit(PRIME))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= SAMPLE_SIZE)
        .select(*key, "order_date", "tree", F.floor(F.col("tree") / TREES_PER_GROUP).alias("group"), "slabs")
    )


def isolation_scores(
    vectors: DataFrame,
    series_key: Sequence[str] = (),
    max_features: Sequence[float] = IF_MAX_FEATURES,
    estimators: Sequence[int] = IF_ESTIMATORS,
    seed: int = 42,
) -> DataFrame:
    """Anomaly score 2^(-mean path / c(sample)) per day, feature set, column fraction and forest size.

    Smaller forests are prefixes of the largest. Work is split by (series, feature set, group of trees, slab of points):
    a unit sees the hash-ranked samples of its trees (at most 256 rows a tree) and at most 4,096 days.
    """
    n_trees = max(estimators)
    groups = math.ceil(n_trees / TREES_PER_GROUP)
    key = list(series_key)
    everything = Window.partitionBy(*key, "feature_set")
    row = F.row_number().over(everything.orderBy("order_date")) - 1
    placed = vectors.withColumns({"n": F.count("*").over(everything), "slab": F.floor(row / POINTS_PER_GROUP)})
    days = vectors.select(*key, "order_date").distinct().withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    days = days.withColumn("slabs", F.ceil(F.col("n") / POINTS_PER_GROUP))

    unit = [*key, "feature_set", "group", "slab"]
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    samples = (
        draw_samples(days, key, n_trees, seed)
        .join(vectors.select(*key, "feature_set", "order_date", "vec"), [*key, "order_date"])
        .withColumn("slab", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slabs") - 1)))
        # Fresh names: both sides of the cogroup descend from the same frame.
        .select(*[F.col(c).alias(c) for c in (*unit, "tree", "order_date", "vec")])
        .repartition(partitions, *unit)
    )
    points = (
        placed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
        .select(*unit, "order_date", "is_true_anomaly", "vec")
        .repartition(partitions, *unit)
    )
    carried = [*key, "feature_set", "order_date", "is_true_anomaly"]
    schema = T.StructType(
        [
            *[points.schema[c] for c in carried],
            T.StructField("max_features", T.DoubleType()),
            T.StructField("trees_upto", T.IntegerType()),
            T.StructField("depth", T.LongType()),
            T.StructField("sample_size", T.IntegerType()),
        ]
    )

    def grow(sample: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        if sample.empty or pts.empty:
            return pd.DataFrame(columns=schema.names)
        def whole(vectors) -> np.ndarray:
            return np.rint(np.stack(vectors.to_numpy()) * UNITS).astype(np.int64)

        data, feature_set = whole(pts["vec"]), pts["feature_set"].iloc[0]
        by_tree = {int(t): whole(g.sort_values("order_date")["vec"]) for t, g in sample.groupby("tree")}
        # Fractions that come to the same number of columns share their trees.
        widths = {f: max(1, int(f * data.shape[1])) for f in max_features}
        total = {}
        for width in set(widths.values()):
            depth = np.zeros(len(data), np.int64)
            for tree, rows in by_tree.items():
                draw = tree_draw(feature_set, width, tree, seed)
                depth += tree_depths(rows, data, tree_columns(data.shape[1], width, draw), draw)
            total[width] = depth
        out = [
            pts[carried].assign(
                max_features=fraction,
                trees_upto=max(by_tree) + 1,
                depth=total[width],
                sample_size=max(len(r) for r in by_tree.values()),
            )
            for fraction, width in widths.items()
        ]
        return pd.concat(out)

    partial = samples.groupBy(*unit).cogroup(points.groupBy(*unit)).applyInPandas(grow, schema)
    sums = partial.groupBy(*key, "order_date", "is_true_anomaly", "feature_set", "max_features").agg(
        *[F.sum(F.when(F.col("trees_upto") <= m, F.col("depth"))).alias(f"n{m}") for m in estimators],
        F.max("sample_size").alias("sample_size"),
    )
    psi = F.col("sample_size").cast("double")
    normal = F.when(
        psi > 2, 2 * (F.log(psi - 1) + F.lit(float(np.euler_gamma))) - 2 * (psi - 1) / psi
    ).otherwise(F.lit(1.0))
    per_size = F.array(
        *[
            F.struct(
                F.lit(m).alias("n_estimators"),
                F.pow(F.lit(2.0), -(F.col(f"n{m}") / F.lit(m * UNITS)) / normal).alias("score"),
            )
            for m in estimators
        ]
    )
    return sums.select(*key, "order_date", "is_true_anomaly", "feature_set", "max_features", F.inline(per_size))
