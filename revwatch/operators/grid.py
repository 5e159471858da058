"""Hyper-parameter grid: one score frame per detector family, cut once per threshold, summed into ``model_results``."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revwatch.functions.labels import success
from revwatch.functions.numeric import ratio
from revwatch.operators.detectors import density, isolation, pointwise, sequential
from revwatch.operators.features import FEATURE_SETS, feature_vectors
from revwatch.sources.schemas import MODEL_RESULTS

NAMES = {
    "IsolationForest": "IF_n{n_estimators}_c{contamination}_mf{max_features}",
    "LocalOutlierFactor": "LOF_k{n_neighbors}_c{contamination}",
    "DBSCAN": "DBSCAN_eps{eps}_ms{min_samples}",
    "ZScore": "Z_t{threshold}",
    "RollingZScore": "RollingZ_w{window}_t{threshold}",
    "STL_Residual": "STL_p{period}_t{threshold}",
    "SeasonalResidual": "Seasonal_p{period}_t{threshold}",
    "EWM_ZScore": "EWM_s{span}_t{threshold}",
    "IQR": "IQR_t{threshold}",
    "MAD": "MAD_t{threshold}",
}


def model_name(method: str) -> Column:
    """Model name with its hyper-parameters, built from the typed columns."""
    parts = []
    for literal, field, _, _ in Formatter().parse(NAMES[method]):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(F.col(field).cast("string"))
    return F.concat(*parts)


def _cells(groups: DataFrame, keys: Sequence[str], name: str, values: Sequence, flagged: Callable[..., Column]):
    """Flag and hit counts of every cut in one aggregation: the cuts are columns, the score rows are not multiplied."""
    truth = F.col("is_true_anomaly") == 1
    aggs = [F.count("*").alias("total_days")]
    for i, v in enumerate(values):
        hit = F.coalesce(flagged(i, v), F.lit(False))
        aggs += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & truth).alias(f"tp{i}")]
    counted = groups.groupBy(*keys).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(v).alias(name),
                F.col(f"n{i}").alias("anomalies_detected"),
                F.col(f"tp{i}").alias("true_positives"),
            )
            for i, v in enumerate(values)
        ]
    )
    return counted.select(*keys, "total_days", F.inline(cells))


def threshold_cells(scores: DataFrame, keys: Sequence[str], thresholds: Sequence[float], name="threshold"):
    return _cells(scores, keys, name, thresholds, lambda i, t: F.col("score") > t)


def contamination_cells(scores: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Flags the share of days with the highest score: strictly beyond the interpolated quantile of the negated score.

    The quantile is taken per series and parameter set, a group bounded by the calendar.
    """
    # A window, not an aggregate joined back: the scores are expensive and must be computed once.
    quantiles = F.percentile("neg", F.array(*[F.lit(s) for s in shares])).over(Window.partitionBy(*keys))
    cut = scores.withColumn("neg", -F.round("score", 6)).withColumn("cuts", quantiles)
    return _cells(cut, keys, "contamination", shares, lambda i, s: F.col("neg") < F.col("cuts")[i])


def finish(cells: DataFrame, method: str, series_key: Sequence[str] = (), scaler: str = "none") -> DataFrame:
    """Typed result columns of one family."""
    pct = ratio(F.col("anomalies_detected"), F.col("total_days"), 1, 100)
    sizes = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(len(v))) for k, v in FEATURE_SETS.items()]))
    typed = cells.withColumns(
        {
            "model": model_name(method),
            "method_type": F.lit(method),
            "scaler": F.lit(scaler),
            "n_features": F.coalesce(F.try_element_at(sizes, F.col("feature_set")), F.lit(1)),
            "anomaly_pct": pct,
            "success": success(pct),
        }
    )
    columns = [
        (F.col(f.name) if f.name in typed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in MODEL_RESULTS.fields
    ]
    return typed.select(*series_key, *columns)


# --- families ---


def grid_zscore(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = pointwise.zscore_scores(features, series_key)
    cells = threshold_cells(scores, [*series_key, "feature_set"], pointwise.ZSCORE_THRESHOLDS)
    return finish(cells, "ZScore", series_key)


def grid_rolling_z(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = pointwise.rolling_scores(features, series_key)
    cells = threshold_cells(scores, [*series_key, "feature_set", "window"], pointwise.SERIES_THRESHOLDS)
    return finish(cells, "RollingZScore", series_key)


def grid_ewm(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = sequential.ewm_scores(features, series_key)
    cells = threshold_cells(scores, [*series_key, "feature_set", "span"], pointwise.SERIES_THRESHOLDS)
    return finish(cells, "EWM_ZScore", series_key)


def grid_stl(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = sequential.stl_scores(features, series_key)
    cells = threshold_cells(scores, [*series_key, "feature_set", "period"], pointwise.SERIES_THRESHOLDS)
    return finish(cells, "STL_Residual", series_key)


def grid_seasonal_resid(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = sequential.seasonal_scores(features, series_key)
    cells = threshold_cells(scores, [*series_key, "feature_set", "period"], pointwise.SERIES_THRESHOLDS)
    return finish(cells, "SeasonalResidual", series_key)


def grid_iqr(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = pointwise.iqr_scores(features, series_key)
    return finish(threshold_cells(scores, [*series_key, "feature_set"], pointwise.IQR_MULTIPLIERS), "IQR", series_key)


def grid_mad(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = pointwise.mad_scores(features, series_key)
    return finish(threshold_cells(scores, [*series_key, "feature_set"], pointwise.MAD_THRESHOLDS), "MAD", series_key)


def grid_lof(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = density.lof_scores(feature_vectors(features, series_key), series_key)
    keys = [*series_key, "feature_set", "n_neighbors"]
    cells = contamination_cells(scores, keys, density.LOF_CONTAMINATION)
    return finish(cells, "LocalOutlierFactor", series_key, "standard")


def grid_dbscan(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    reach = density.best_reachable_density(feature_vectors(features, series_key), series_key)
    cells = _cells(
        reach, [*series_key, "feature_set", "eps"], "min_samples", density.DBSCAN_MIN_SAMPLES,
        lambda i, m: F.col("density") < m,
    )
    return finish(cells, "DBSCAN", series_key, "standard")


def grid_iforest(features: DataFrame, series_key: Sequence[str] = ()) -> DataFrame:
    scores = isolation.isolation_scores(feature_vectors(features, series_key), series_key)
    keys = [*series_key, "feature_set", "max_features", "n_estimators"]
    cells = contamination_cells(scores, keys, isolation.IF_CONTAMINATION)
    return finish(cells, "IsolationForest", series_key, "standard")


# The seven families of the reference grid, then the cheap families that are only described there.
GRID_FAMILIES = {
    "IsolationForest": grid_iforest,
    "LocalOutlierFactor": grid_lof,
    "DBSCAN": grid_dbscan,
    "ZScore": grid_zscore,
    "RollingZScore": grid_rolling_z,
    "STL_Residual": grid_stl,
    "EWM_ZScore": grid_ewm,
}
EXTRA_FAMILIES = {"SeasonalResidual": grid_seasonal_resid, "IQR": grid_iqr, "MAD": grid_mad}
ALL_FAMILIES = {**GRID_FAMILIES, **EXTRA_FAMILIES}
# What result tables and their reports run on: all of them, with the native seasonal residual in the place of STL.
DEFAULT_FAMILIES = tuple(f for f in ALL_FAMILIES if f != "STL_Residual")


def run_grid(features: DataFrame, families: Sequence[str] = tuple(GRID_FAMILIES), series_key: Sequence[str] = ()):
    """``model_results`` of the chosen families."""
    out = None
    for name in families:
        frame = ALL_FAMILIES[name](features, series_key)
        out = frame if out is None else out.unionByName(frame)
    return out


def grid_definition(spark: SparkSession) -> DataFrame:
    """Every configuration of the seven-family grid, as rows."""
    sets = tuple(FEATURE_SETS)
    axes = {
        "IsolationForest": (isolation.IF_CONTAMINATION, isolation.IF_ESTIMATORS, isolation.IF_MAX_FEATURES, sets),
        "LocalOutlierFactor": (density.LOF_NEIGHBORS, density.LOF_CONTAMINATION, sets),
        "DBSCAN": (density.DBSCAN_EPS, density.DBSCAN_MIN_SAMPLES, sets),
        "ZScore": (pointwise.ZSCORE_THRESHOLDS, pointwise.ZSCORE_FEATURES),
        "RollingZScore": (pointwise.SERIES_WINDOWS, pointwise.SERIES_THRESHOLDS, pointwise.SERIES_FEATURES),
        "STL_Residual": (sequential.STL_PERIODS, pointwise.SERIES_THRESHOLDS, pointwise.SERIES_FEATURES),
        "EWM_ZScore": (pointwise.SERIES_WINDOWS, pointwise.SERIES_THRESHOLDS, pointwise.SERIES_FEATURES),
    }
    rows = [
        (method, config[-1], "|".join(str(v) for v in config[:-1]))
        for method, values in axes.items()
        for config in itertools.product(*values)
    ]
    return spark.createDataFrame(rows, "method_type string, feature_set string, params string")


def grid_coverage(results: DataFrame) -> DataFrame:
    """Per method of the definition or of ``results``: configurations asked for and found, 0 where there are none."""
    defined = grid_definition(results.sparkSession).groupBy("method_type").agg(F.count("*").alias("defined_configs"))
    ran = results.groupBy("method_type").agg(F.count("*").alias("configs"), F.max("total_days").alias("total_days"))
    return defined.join(ran, "method_type", "full").na.fill(0, ["defined_configs", "configs"])


def grid_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("configs"),
        F.count_if(F.col("success") == "yes").alias("successful"),
        F.max("true_positives").alias("best_true_positives"),
        F.countDistinct("method_type").alias("methods"),
    )
