"""Density detectors over scaled feature vectors: local outlier factor and density noise (DBSCAN)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revwatch.operators.detectors.blocks import block_pairs, distances, to_blocks
from revwatch.operators.features import FEATURE_SETS
from revwatch.session import materialize

# Hyper-parameters of the grid.
LOF_NEIGHBORS = (5, 10, 15, 20, 25, 30, 40)
LOF_CONTAMINATION = (0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15)
DBSCAN_EPS = (0.3, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0)
DBSCAN_MIN_SAMPLES = (2, 3, 5, 7, 10, 15, 20)
MAX_DIMS = max(len(cols) for cols in FEATURE_SETS.values())


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _repeat_keys(row, keys: Sequence[str], n: int) -> dict:
    return {k: [getattr(row, k)] * n for k in keys}


def _as_dates(frame: DataFrame) -> DataFrame:
    return frame.withColumn("order_date", F.date_from_unix_date("day")).drop("day")


# --- local outlier factor ---


def nearest_neighbors(vectors: DataFrame, keys: Sequence[str], k: int, dims: int = MAX_DIMS) -> DataFrame:
    """The k nearest other days of every day, as ``nn: array<struct<d, nb>>`` sorted by (distance, day).

    A block first bounds how far its own points' neighbours can be; only blocks within that radius are compared.
    """

    @F.pandas_udf("double")
    def radius(days: pd.Series, vecs: pd.Series) -> pd.Series:
        def bound(n: int, flat) -> float:
            if n <= k:
                return float("inf")
            # Row-wise k-th distance to another point: index 0 of the sorted row is the point itself.
            return float(np.partition(distances(flat, n, flat, n), k, axis=1)[:, k].max())

        return pd.Series([bound(len(d), v) for d, v in zip(days, vecs)])

    blocks = materialize(to_blocks(vectors, keys, dims).withColumn("radius", radius("days", "vecs")), "blocks")
    pairs = block_pairs(blocks, keys, F.col("radius"))
    schema = T.StructType(
        [
            *_key_fields(blocks, keys),
            T.StructField("day", T.IntegerType()),
            T.StructField("d", T.ArrayType(T.DoubleType())),
            T.StructField("nb", T.ArrayType(T.IntegerType())),
        ]
    )

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                days, days_b = np.asarray(row.days), np.asarray(row.days_b)
                dist = distances(row.vecs, len(days), row.vecs_b, len(days_b))
                dist[days[:, None] == days_b[None, :]] = np.inf
                nearest = np.argsort(dist, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(dist, nearest, axis=1)
                real = np.isfinite(best).sum(axis=1)
                yield pd.DataFrame(
                    {
                        **_repeat_keys(row, keys, len(days)),
                        "day": days,
                        "d": [x[:m] for x, m in zip(best, real)],
                        "nb": [x[:m] for x, m in zip(days_b[nearest], real)],
                    }
                )

    found = pairs.mapInPandas(candidates, schema)
    merged = found.groupBy(*keys, "day").agg(F.flatten(F.collect_list(F.arrays_zip("d", "nb"))).alias("nn"))
    return _as_dates(merged.withColumn("nn", F.slice(F.sort_array("nn"), 1, k)))


def lof_scores(
    vectors: DataFrame, series_key: Sequence[str] = (), neighbors: Sequence[int] = LOF_NEIGHBORS
) -> DataFrame:
    """Local outlier factor of every day for every neighbourhood size, from one neighbour table.

    The lists of a smaller k are prefixes of the longest one, so all sizes share the same two joins.
    """
    keys = [*series_key, "feature_set"]
    nn = materialize(nearest_neighbors(vectors, keys, max(neighbors)), "neighbors")  # read by three joins

    def k_distance(k: int):
        return F.element_at("nn.d", F.least(F.lit(k), F.size("nn")))

    reach = nn.filter(F.size("nn") > 0).select(
        *keys, "order_date", "nn", F.array(*[k_distance(k) for k in neighbors]).alias("k_dist")
    )
    edges = reach.select(*keys, "order_date", F.posexplode("nn").alias("pos", "edge")).select(
        *keys,
        "order_date",
        "pos",
        F.date_from_unix_date("edge.nb").alias("nb"),
        F.col("edge.d").alias("d"),
    )

    def over_first(k: int, value):
        return F.avg(F.when(F.col("pos") < k, value))

    nb_reach = reach.select(*keys, F.col("order_date").alias("nb"), "k_dist")
    density = (
        edges.join(nb_reach, [*keys, "nb"])
        .groupBy(*keys, "order_date")
        .agg(
            F.array(
                *[
                    F.lit(1.0) / (over_first(k, F.greatest("d", F.col("k_dist")[i])) + F.lit(1e-10))
                    for i, k in enumerate(neighbors)
                ]
            ).alias("lrd")
        )
    )
    nb_density = density.select(*keys, F.col("order_date").alias("nb"), F.col("lrd").alias("nb_lrd"))
    factor = (
        edges.select(*keys, "order_date", "pos", "nb")
        .join(nb_density, [*keys, "nb"])
        .join(density, [*keys, "order_date"])
        .groupBy(*keys, "order_date")
        .agg(*[over_first(k, F.col("nb_lrd")[i] / F.col("lrd")[i]).alias(f"k{k}") for i, k in enumerate(neighbors)])
    )
    per_k = F.array(*[F.struct(F.lit(k).alias("n_neighbors"), F.col(f"k{k}").alias("score")) for k in neighbors])
    truth = vectors.select(*keys, "order_date", "is_true_anomaly")
    return factor.join(truth, [*keys, "order_date"]).select(
        *keys, "order_date", "is_true_anomaly", F.inline(per_k)
    )


# --- DBSCAN noise ---


def _fold_pairs(pairs: DataFrame, keys: Sequence[str], eps: Sequence[float], fold) -> DataFrame:
    """Per point of block a and radius, ``fold(inside, row)`` over the points of block b within the radius."""
    names = [f"e{i}" for i in range(len(eps))]
    schema = T.StructType(
        [
            *_key_fields(pairs, keys),
            T.StructField("day", T.IntegerType()),
            *[T.StructField(n, T.LongType()) for n in names],
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n_a, n_b = len(row.days), len(row.days_b)
                dist = distances(row.vecs, n_a, row.vecs_b, n_b)
                folded = {name: fold(dist <= e, i, row) for i, (name, e) in enumerate(zip(names, eps))}
                yield pd.DataFrame({**_repeat_keys(row, keys, n_a), "day": row.days, **folded})

    return pairs.mapInPandas(run, schema)


def neighbor_counts(vectors: DataFrame, keys: Sequence[str], eps: Sequence[float], dims: int = MAX_DIMS) -> DataFrame:
    """Points within each radius (the point itself included), as ``counts: array<bigint>``."""
    blocks = materialize(to_blocks(vectors, keys, dims), "blocks")
    pairs = block_pairs(blocks, keys, F.lit(float(max(eps))))
    partial = _fold_pairs(pairs, keys, eps, lambda inside, i, row: inside.sum(axis=1))
    counts = partial.groupBy(*keys, "day").agg(
        F.array(*[F.sum(f"e{i}") for i in range(len(eps))]).alias("counts")
    )
    return _as_dates(counts)


def best_reachable_density(
    vectors: DataFrame, series_key: Sequence[str] = (), eps: Sequence[float] = DBSCAN_EPS, dims: int = MAX_DIMS
) -> DataFrame:
    """Largest neighbour count among the points within each radius of a point, long over ``eps``.

    A point is noise for (eps, min_samples) exactly when this number is below min_samples: no core point, itself
    included, lies within eps. One frame therefore answers every min_samples.
    """
    keys = [*series_key, "feature_set"]
    counted = vectors.join(neighbor_counts(vectors, keys, eps, dims), [*keys, "order_date"])
    blocks = materialize(to_blocks(counted, keys, dims, "counts"), "blocks")
    pairs = block_pairs(blocks, keys, F.lit(float(max(eps))))

    def densest(inside, i, row):
        counts = np.asarray(row.counts_b).reshape(len(row.days_b), -1)[:, i]
        return np.where(inside, counts[None, :], 0).max(axis=1)

    partial = _fold_pairs(pairs, keys, eps, densest)
    best = _as_dates(
        partial.groupBy(*keys, "day").agg(*[F.max(f"e{i}").alias(f"e{i}") for i in range(len(eps))])
    )
    per_eps = F.array(*[F.struct(F.lit(e).alias("eps"), F.col(f"e{i}").alias("density")) for i, e in enumerate(eps)])
    truth = vectors.select(*keys, "order_date", "is_true_anomaly")
    return best.join(truth, [*keys, "order_date"]).select(
        *keys, "order_date", "is_true_anomaly", F.inline(per_eps)
    )
