"""Root-cause tables over ``model_results``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.labels import MODEL_PARAM_PATTERNS, param, quality, rate_class
from revwatch.functions.numeric import ratio, share_pct

TIME_SERIES_METHODS = ("RollingZScore", "EWM_ZScore", "STL_Residual", "SeasonalResidual")


def _pct() -> Column:
    return F.col("anomaly_pct")


def _tenths() -> Column:
    """Rates carry one digit, so their sums are exact in decimal."""
    return _pct().cast("decimal(18,1)")


def mean_pct(scale: int = 2) -> Column:
    return ratio(F.sum(_tenths()), F.count(_tenths()), scale)


def is_reasonable() -> Column:
    return rate_class(_pct()) == "reasonable"


def is_broken() -> Column:
    return rate_class(_pct()) == "broken"


def _without_statistical(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("method_type").contains("Statistical"))


def classify(results: DataFrame) -> DataFrame:
    return results.select(
        "model", "method_type", "feature_set", "anomaly_pct",
        rate_class(_pct()).alias("rate_class"), quality(_pct()).alias("quality"),
    )


def parse_model_params(results: DataFrame) -> DataFrame:
    """Hyper-parameters read back from the model name."""
    parsed = [param("model", pattern).alias(name) for name, pattern in MODEL_PARAM_PATTERNS.items()]
    return results.select("model", "method_type", "feature_set", *parsed)


def method_performance(results: DataFrame) -> DataFrame:
    return results.groupBy("method_type").agg(
        F.count("model").alias("total_configs"),
        F.count_if(is_reasonable()).alias("reasonable_configs"),
        F.count_if(is_broken()).alias("broken_configs"),
        mean_pct().alias("avg_anomaly_pct"),
        F.min("anomaly_pct").alias("min_anomaly_pct"),
        F.max("anomaly_pct").alias("max_anomaly_pct"),
        F.round(F.stddev_samp("anomaly_pct"), 2).alias("std_anomaly_pct"),
        share_pct(is_reasonable()).alias("success_rate_pct"),
        share_pct(is_broken()).alias("failure_rate_pct"),
    )


def feature_set_impact(results: DataFrame) -> DataFrame:
    return (
        _without_statistical(results)
        .groupBy("feature_set")
        .agg(
            F.count("model").alias("total_configs"),
            share_pct(is_reasonable()).alias("reasonable_pct"),
            share_pct(is_broken()).alias("broken_pct"),
            mean_pct().alias("avg_anomaly_pct"),
            F.max("n_features").alias("n_features_used"),
        )
    )


def scaler_impact(results: DataFrame) -> DataFrame:
    return (
        _without_statistical(results)
        .groupBy("scaler", "method_type")
        .agg(
            F.count("model").alias("total"),
            F.count_if(is_reasonable()).alias("reasonable"),
            F.count_if(is_broken()).alias("broken"),
            mean_pct().alias("avg_pct"),
            share_pct(is_reasonable()).alias("success_rate"),
        )
    )


def dbscan_sensitivity(results: DataFrame) -> DataFrame:
    """DBSCAN rates by feature set, scaler and the eps written in the model name."""
    return (
        results.filter(F.col("method_type") == "DBSCAN")
        .withColumn("eps", param("model", MODEL_PARAM_PATTERNS["eps"]))
        .groupBy("feature_set", "scaler", "eps")
        .agg(
            mean_pct().alias("avg_anomaly_pct"),
            F.max("anomaly_pct").alias("max_anomaly_pct"),
            F.count_if(_pct() >= 50).alias("configs_over_50"),
            F.count("*").alias("configs"),
        )
    )


def param_failure(results: DataFrame, params: Sequence[str] = tuple(MODEL_PARAM_PATTERNS)) -> DataFrame:
    """Failure rate (more than 20 % flagged) by every value of every parsed hyper-parameter."""
    parsed = F.array(
        *[F.struct(F.lit(p).alias("param"), param("model", MODEL_PARAM_PATTERNS[p]).alias("value")) for p in params]
    )
    return (
        results.select("model", "method_type", "anomaly_pct", F.inline(parsed))
        .filter(F.col("value").isNotNull())
        .groupBy("method_type", "param", "value")
        .agg(
            mean_pct().alias("avg_anomaly_pct"),
            F.count_if(_pct() > 20).alias("broken_count"),
            F.count("model").alias("total"),
            share_pct(_pct() > 20).alias("failure_rate"),
        )
    )


def best_configurations(results: DataFrame, per_method: int = 3) -> DataFrame:
    """Configurations that flag 4-6 %, the closest to 5 % per method; ties by name, then feature set."""
    near = results.filter(_pct().between(4, 6)).withColumn("distance", F.abs(_tenths() - 5))
    order = Window.partitionBy("method_type").orderBy("distance", "model", "feature_set")
    return (
        near.withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= per_method)
        .select("model", "method_type", "feature_set", "scaler", "n_features", "anomaly_pct")
    )


def contamination_sensitivity(results: DataFrame) -> DataFrame:
    return (
        results.withColumn("contamination", param("model", MODEL_PARAM_PATTERNS["contamination"]))
        .filter(F.col("contamination").isNotNull())
        .groupBy("method_type", "contamination")
        .agg(
            mean_pct().alias("avg_anomaly_pct"),
            F.round(F.stddev_samp("anomaly_pct"), 2).alias("std_anomaly_pct"),
            F.count("model").alias("configs"),
        )
    )


def rca_report(results: DataFrame) -> dict[str, DataFrame]:
    """The seven root-cause tables, ready for ``sinks.write_tables``."""
    return {
        "rca_method": method_performance(results),
        "rca_feature_set": feature_set_impact(results),
        "rca_scaler": scaler_impact(results),
        "rca_dbscan": dbscan_sensitivity(results),
        "rca_param_failure": param_failure(results),
        "rca_best": best_configurations(results),
        "rca_contamination": contamination_sensitivity(results),
    }


def ts_vs_static(results: DataFrame, methods=TIME_SERIES_METHODS) -> DataFrame:
    family = F.when(F.col("method_type").isin(*methods), "time_series").otherwise("static")
    return results.groupBy(family.alias("family")).agg(
        F.count("*").alias("configs"),
        F.max("true_positives").alias("best_tp"),
        ratio(F.sum("true_positives"), F.count("true_positives"), 1).alias("avg_tp"),
    )


def method_tp_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("method_type").agg(
        F.count("model").alias("total_configs"),
        share_pct(F.col("success") == "yes").alias("success_rate"),
        mean_pct(1).alias("avg_anomaly_pct"),
        F.max("true_positives").alias("max_true_positives"),
        ratio(F.sum("true_positives"), F.count("true_positives"), 1).alias("avg_true_positives"),
    )


def model_cards(results: DataFrame) -> DataFrame:
    working, broken = _pct().between(3, 10), _pct() > 20
    return results.agg(
        F.count("*").alias("tested"),
        F.count_if(working).alias("working"),
        share_pct(working, 0).alias("working_pct"),
        F.count_if(broken).alias("broken"),
        share_pct(broken, 0).alias("broken_pct"),
        F.countDistinct("method_type").alias("methods"),
    )


def method_success(results: DataFrame) -> DataFrame:
    return results.groupBy("method_type").agg(
        F.count("model").alias("configs"),
        F.count_if(_pct().between(3, 10)).alias("success"),
        share_pct(_pct().between(3, 10)).alias("success_rate"),
        mean_pct(1).alias("avg_anomaly_pct"),
        share_pct(_pct() > 20).alias("broken_pct"),
    )


def feature_bubble(results: DataFrame) -> DataFrame:
    return results.groupBy("feature_set").agg(
        mean_pct(1).alias("avg_anomaly"),
        F.count_if(_pct() > 20).alias("broken"),
        F.max("n_features").alias("n_features"),
    )


def heatmap(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean flag rate and success rate, feature sets down and methods across."""
    return (
        results.groupBy("feature_set")
        .pivot("method_type", list(methods))
        .agg(mean_pct(1).alias("avg_pct"), share_pct(_pct().between(3, 10)).alias("success_rate"))
    )
