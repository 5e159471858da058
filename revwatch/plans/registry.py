"""Every registered query: name -> (warehouse -> DataFrame)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.functions.numeric import publish
from revwatch.functions.subquery import only_row
from revwatch.operators import baselines, evaluate, features, grid, hypothesis, kpis, quality, rca, sketches, star
from revwatch.operators.detectors import density, isolation, pointwise, sequential
from revwatch.operators.calendar import calendar_years, holiday_calendar
from revwatch.operators.global_order import exact_quantiles_by, quantile_name
from revwatch.plans import business, questions
from revwatch.plans.warehouse import Warehouse, open_warehouse
from revwatch.session import fresh_path
from revwatch.sources import contract, incremental, sinks
from revwatch.sources.tables import from_csv_checked
from revwatch.streaming import kpis as streaming
from revwatch.streaming import monitor, ordered

Query = Callable[[Warehouse], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(QUERIES[name](open_warehouse(spark, sf_dir)))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources and sinks ---


@register
def src_counts(w):
    out = None
    for name in contract.EXPECTED:
        frame = w.table(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = frame if out is None else out.unionByName(frame)
    return out


@register
def contract_check(w):
    return contract.contract_check(w.spark, w.sf_dir)


@register
def sink_roundtrip(w):
    """Facts written partitioned by month, read back and summed per month."""
    path = fresh_path(w.spark, "sink_roundtrip")
    back = sinks.write_table(w.fact_orders, path, "order_date")
    return back.groupBy("month").agg(
        F.count("*").alias("orders"), F.sum("order_value").cast("double").alias("revenue")
    )


@register
def csv_roundtrip(w):
    """Grid results written as CSV with a header, read back with their types, and summed per method."""
    path = fresh_path(w.spark, "csv_roundtrip")
    sinks.write_csv(w.model_results, path)
    back = sinks.read_model_results_csv(w.spark, path)
    return back.groupBy("method_type").agg(
        F.count("*").alias("configs"),
        F.sum("anomalies_detected").cast("bigint").alias("anomalies"),
        F.sum("true_positives").cast("bigint").alias("true_positives"),
    )


@register
def rca_report(w):
    """The root-cause report written as tables and read back: rows and columns of each."""
    written = sinks.write_tables(rca.rca_report(w.model_results), fresh_path(w.spark, "rca_report"))
    out = None
    for name, frame in written.items():
        row = frame.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


# --- star schema ---


@register
def order_dates(w):
    orders = w.sources.orders
    return orders.groupBy("order_date").agg(F.count("*").alias("orders"))


@register
def valid_orders(w):
    return star.valid_orders(w.valid_sources.orders).select("order_id", "customer_id", "order_status", "order_date")


@register
def order_totals(w):
    return star.order_totals(w.sources.items)


@register
def fact_orders(w):
    s = w.valid_sources
    return star.build_fact_orders(s.orders, s.items, s.customers)


@register
def dim_customers(w):
    s = w.valid_sources
    return star.build_dim_customers(star.build_fact_orders(s.orders, s.items, s.customers))


@register
def dim_products(w):
    return star.build_dim_products(w.sources.items, w.sources.products)


@register
def spend_quantiles(w):
    cuts = star.spend_quantiles(star.customer_spend(w.fact_orders))
    return _rounded(cuts, 4, "q75", "q95", "q99")


@register
def tier_counts(w):
    return business.tier_counts(w.dim_customers)


@register
def orphan_customers(w):
    """Customers seen only in orders outside the accepted statuses."""
    return star.orphan_customers(w.fact_orders_all, w.dim_customers)


@register
def order_summary(w):
    return quality.describe(
        w.fact_orders.select("order_value", "freight_value", "items_count", "unique_products"),
        ["order_value", "freight_value", "items_count", "unique_products"],
    )


# --- KPI series ---


@register
def daily_kpis(w):
    s = w.valid_sources
    return kpis.build_daily_kpis(star.build_fact_orders(s.orders, s.items, s.customers))


@register
def daily_kpis_by_state(w):
    return kpis.build_daily_kpis(w.fact_orders.withColumnRenamed("customer_state", "state"), ["state"])


@register
def label_events(w):
    return kpis.label_ground_truth(kpis.build_daily_kpis(w.fact_orders), w.calendar)


@register
def ground_truth(w):
    return kpis.ground_truth(w.daily_kpis, w.calendar)


@register
def etl_metrics(w):
    return w.build_metrics()


@register
def baseline_90d(w):
    return _rounded(kpis.rolling_baseline(w.daily_kpis, "daily_revenue"), 4, "baseline_mean", "baseline_std")


@register
def seasonal_z(w):
    out = kpis.seasonal_zscore(w.daily_kpis, "daily_revenue")
    return _rounded(out.select("order_date", "daily_revenue", "month_num", "seasonal_z"), 4, "seasonal_z")


# --- features ---


def _feature_frame(w):
    return _rounded(features.build_features(w.daily_kpis), 6, *features.ALL_FEATURES)


QUERIES["features"] = _feature_frame


def _scaled(w, scaler):
    return scaler(w.features, features.BASE_FEATURES).select("order_date", *features.BASE_FEATURES)


@register
def scale_standard(w):
    return _scaled(w, features.scale_standard)


@register
def scale_minmax(w):
    return _scaled(w, features.scale_minmax)


@register
def scale_robust(w):
    return _scaled(w, features.scale_robust)


# --- detectors and grid ---

_RESULT_ORDER = [
    "model", "method_type", "feature_set", "scaler", "n_features", "contamination", "n_estimators", "max_features",
    "n_neighbors", "eps", "min_samples", "threshold", "window", "period", "span", "anomalies_detected", "anomaly_pct",
    "total_days", "true_positives", "success",
]
_SPARSE = _RESULT_ORDER[5:15]


def _results(df: DataFrame) -> DataFrame:
    """Sparse hyper-parameters as doubles, so that absent ones read alike everywhere."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in _SPARSE else F.col(c) for c in _RESULT_ORDER])


def _family(key: str, build) -> None:
    def query(w):
        return _results(build(w.features))

    query.__name__ = key
    register(query)


for _key, _build in {
    "grid_zscore": grid.grid_zscore,
    "grid_rolling_z": grid.grid_rolling_z,
    "grid_ewm": grid.grid_ewm,
    "grid_seasonal_resid": grid.grid_seasonal_resid,
    "grid_iqr": grid.grid_iqr,
    "grid_mad": grid.grid_mad,
    "grid_lof": grid.grid_lof,
    "grid_dbscan": grid.grid_dbscan,
    "grid_stl": grid.grid_stl,
    "grid_iforest": grid.grid_iforest,
}.items():
    _family(_key, _build)


@register
def grid_zscore_by_state(w):
    """The z-score family over one series per state."""
    fact = w.fact_orders.withColumnRenamed("customer_state", "state")
    daily = kpis.label_ground_truth(kpis.build_daily_kpis(fact, ["state"]), w.calendar)
    out = grid.grid_zscore(features.build_features(daily, ["state"]), ["state"])
    return out.select("state", "model", "feature_set", "anomalies_detected", "anomaly_pct", "total_days",
                      "true_positives", "success")


@register
def grid_size(w):
    """Configurations run on the daily series against the grid definition."""
    return grid.grid_coverage(w.model_results)


@register
def model_results(w):
    return _results(w.model_results)


@register
def model_results_all(w):
    return _results(w.model_results_all)


@register
def grid_summary(w):
    return grid.grid_summary(w.model_results)


@register
def grid_summary_all(w):
    return grid.grid_summary(w.model_results_all)


@register
def sigma_band(w):
    return _rounded(pointwise.sigma_band(w.daily_kpis), 4, "lower_limit", "upper_limit")


@register
def alert_driver(w):
    return pointwise.alert_driver(w.daily_kpis)


def _top_share(scores: DataFrame, share: float) -> DataFrame:
    """Days flagged by a contamination cut over one series."""
    neg = scores.withColumn("neg", -F.round("score", 6))
    cut = only_row(neg.agg(F.percentile("neg", F.lit(share)).alias("cut")))["cut"]
    return neg.filter(F.col("neg") < cut).select("order_date", F.round("score", 4).alias("score"))


def _ensemble(w, primary: DataFrame) -> DataFrame:
    z_flags = w.daily_kpis.filter(F.col("anomaly_flag") == 1).select("order_date", "daily_revenue", "z_score")
    return z_flags.join(primary, "order_date")


@register
def ensemble_alerts(w):
    """Days on which the z-score and the local outlier factor (k 20, 5 %) agree."""
    return _ensemble(w, _top_share(w.lof_scores, 0.05))


@register
def ensemble_alerts_iforest(w):
    """Days on which the z-score and the isolation forest (200 trees, 5 %) agree."""
    return _ensemble(w, _top_share(w.forest_scores, 0.05))


# --- evaluation ---


@register
def eval_detector(w):
    return evaluate.evaluate_detector(w.daily_kpis, "is_true_anomaly", "anomaly_flag", method="ZScore")


def _predictions(w) -> DataFrame:
    """One 0/1 column per cheap detector on daily revenue."""
    f = w.features

    def flags(scores: DataFrame, name: str, threshold: float) -> DataFrame:
        hit = F.coalesce(F.col("score") > threshold, F.lit(False)).cast("int")
        return scores.filter(F.col("feature_set") == "daily_revenue").select("order_date", hit.alias(name))

    one = ["daily_revenue"]
    return (
        w.daily_kpis.select("order_date", "is_true_anomaly", F.col("anomaly_flag").alias("zscore_pred"))
        .join(flags(pointwise.rolling_scores(f, (), one, [30]), "rolling_pred", 2.5), "order_date")
        .join(flags(sequential.ewm_scores(f, (), one, [30]), "ewm_pred", 2.5), "order_date")
        .join(flags(pointwise.iqr_scores(f, (), one), "iqr_pred", 1.5), "order_date")
        .join(flags(pointwise.mad_scores(f, (), one), "mad_pred", 3.0), "order_date")
    )


@register
def eval_all_methods(w):
    columns = {
        "ZScore": "zscore_pred", "RollingZScore": "rolling_pred", "EWM_ZScore": "ewm_pred", "IQR": "iqr_pred",
        "MAD": "mad_pred", "Absent": "absent_pred",
    }
    return evaluate.evaluate_all(_predictions(w), columns)


@register
def threshold_sweep(w):
    return evaluate.threshold_sweep(w.daily_kpis)


@register
def best_threshold(w):
    return evaluate.best_threshold(evaluate.threshold_sweep(w.daily_kpis))


@register
def eval_report(w):
    return evaluate.eval_report(w.daily_kpis)


def _z_scores(w) -> DataFrame:
    return w.daily_kpis.select(
        F.lit("ZScore").alias("method"), "order_date", "is_true_anomaly", F.abs("z_score").alias("score")
    )


def _scores(w) -> DataFrame:
    """Scores of the three compared detectors, with the nine digits at which scores meet thresholds."""
    out = _z_scores(w)
    for method, scores in (("LocalOutlierFactor", w.lof_scores), ("IsolationForest", w.forest_scores)):
        out = out.unionByName(
            scores.select(
                F.lit(method).alias("method"), "order_date", "is_true_anomaly", F.round("score", 9).alias("score")
            )
        )
    return out


@register
def anomaly_scores(w):
    return _rounded(_scores(w), 6, "score")


@register
def anomaly_scores_all(w):
    return _rounded(_scores(w), 6, "score")


@register
def roc_curve(w):
    return _rounded(evaluate.roc_curve(_scores(w)), 6, "score", "fpr", "tpr")


@register
def pr_curve(w):
    return _rounded(evaluate.pr_curve(_scores(w)), 6, "score", "recall", "precision")


@register
def roc_auc(w):
    return evaluate.roc_auc(_scores(w))


@register
def pr_auc(w):
    return evaluate.pr_auc(_scores(w))


@register
def auc_all(w):
    """ROC and PR areas of the three compared detectors."""
    scores = _scores(w)
    return evaluate.roc_auc(scores).join(evaluate.pr_auc(scores), "method")


# --- root-cause tables ---

for _key, _op in {
    "rate_class": rca.classify,
    "parse_model_params": rca.parse_model_params,
    "rca_method": rca.method_performance,
    "rca_feature_set": rca.feature_set_impact,
    "rca_scaler": rca.scaler_impact,
    "rca_dbscan": rca.dbscan_sensitivity,
    "rca_param_failure": rca.param_failure,
    "rca_best": rca.best_configurations,
    "rca_contamination": rca.contamination_sensitivity,
    "ts_vs_static": rca.ts_vs_static,
    "method_tp_summary": rca.method_tp_summary,
    "model_cards": rca.model_cards,
    "method_success": rca.method_success,
    "feature_bubble": rca.feature_bubble,
    "best_config": business.best_config,
    "feature_effectiveness": business.feature_effectiveness,
    "boxplot_stats": business.boxplot_stats,
    "ask_models": questions.ask_models,
    "ask_features": questions.ask_features,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.model_results)


@register
def heatmap_pivot(w):
    return rca.heatmap(w.model_results, grid.DEFAULT_FAMILIES)


@register
def rca_method_all(w):
    """Method table over the full seven-family grid."""
    return rca.method_performance(w.model_results_all)


# --- statistics ---


def _with_reasonable(w) -> DataFrame:
    return w.model_results.withColumn("is_reasonable", F.col("anomaly_pct").between(3, 10).cast("int"))


_ROW_ORDER = ["model", "feature_set"]


@register
def bootstrap_ci(w):
    out = hypothesis.bootstrap_ci(_with_reasonable(w), ["method_type"], "is_reasonable", _ROW_ORDER)
    return _rounded(out, 6, "estimate", "ci_lower", "ci_upper")


@register
def bootstrap_ci_poisson(w):
    out = hypothesis.poisson_bootstrap_ci(_with_reasonable(w), ["method_type"], "is_reasonable", _ROW_ORDER)
    return _rounded(out, 6, "estimate", "ci_lower", "ci_upper")


def _paired(w) -> DataFrame:
    return hypothesis.paired_ttest(
        _with_reasonable(w), "is_reasonable", "feature_set", ["revenue_only"], ["multi_feature", "all_features"],
        match_on=["model", "scaler"],
    )


def _one_sample(w) -> DataFrame:
    dbscan = _with_reasonable(w).filter(F.col("method_type") == "DBSCAN")
    return hypothesis.one_sample_ttest(dbscan, "is_reasonable", 0.5)


@register
def paired_ttest(w):
    return _rounded(_paired(w), 6, "improvement_pct", "t", "p_value")


@register
def one_sample_ttest(w):
    return _rounded(_one_sample(w), 6, "mean", "t", "p_value")


@register
def chi_square(w):
    out = hypothesis.chi_square(w.model_results, "method_type", F.col("anomaly_pct").between(3, 10))
    return _rounded(out, 6, "chi2", "p_value")


@register
def contingency(w):
    out = hypothesis.contingency(_with_reasonable(w), "method_type", F.col("is_reasonable"), [0, 1])
    return out.withColumnsRenamed({"0": "failures", "1": "successes"})


@register
def welch_ttest(w):
    out = hypothesis.welch_ttest(w.daily_kpis, "daily_revenue", F.abs("z_score") > 2.5)
    return _rounded(out, 6, "mean_a", "mean_b", "t", "df", "p_value")


@register
def mann_whitney(w):
    out = hypothesis.mann_whitney(w.model_results, "anomaly_pct", "method_type", "IsolationForest", "DBSCAN")
    return _rounded(out, 6, "u", "z", "median_a", "median_b", "p_value")


@register
def mann_whitney_iforest(w):
    out = hypothesis.mann_whitney(w.model_results, "anomaly_pct", "method_type", "IsolationForest", "DBSCAN")
    return _rounded(out, 6, "u", "z", "median_a", "median_b", "p_value")


@register
def normality_jb(w):
    out = hypothesis.jarque_bera(w.daily_kpis, "daily_revenue")
    return _rounded(out, 6, "skewness", "excess_kurtosis", "jb", "p_value")


@register
def claims_table(w):
    """The checked claims as rows: method rates with intervals, the paired improvement, and the DBSCAN test."""

    def claim(df: DataFrame, name, subject, n, estimate, low=None, high=None, t=None, p=None) -> DataFrame:
        def number(c):
            return (F.round(c, 6) if c is not None else F.lit(None)).cast("double")

        return df.select(
            F.lit(name).alias("claim"), subject.alias("subject"), n.cast("bigint").alias("n"),
            number(estimate).alias("estimate"), number(low).alias("ci_lower"), number(high).alias("ci_upper"),
            number(t).alias("t"), number(p).alias("p_value"),
        )

    c = F.col
    rates = hypothesis.bootstrap_ci(_with_reasonable(w), ["method_type"], "is_reasonable", _ROW_ORDER)
    return (
        claim(rates, "success_rate", c("method_type"), c("n"), c("estimate"), c("ci_lower"), c("ci_upper"))
        .unionByName(
            claim(_paired(w), "multi_feature_improvement", F.lit("matched configurations"), c("n_pairs"),
                  c("improvement_pct"), t=c("t"), p=c("p_value"))
        )
        .unionByName(claim(_one_sample(w), "dbscan_below_half", F.lit("DBSCAN"), c("n"), c("mean"), t=c("t"), p=c("p_value")))
    )


# --- business queries over facts, dimensions and days ---

for _key, _op in {
    "monthly_growth": business.monthly_growth,
    "monthly_growth_prev": business.monthly_growth_prev,
    "pareto_quintiles": business.pareto_quintiles,
    "dow_orders": business.dow_orders,
    "state_revenue": business.state_revenue,
    "month_of_year": business.month_of_year,
    "seasonal_month_check": business.seasonal_month_check,
    "order_value_hist": business.order_value_hist,
    "ask_monthly": questions.ask_monthly,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.fact_orders)

for _key, _op in {
    "zscore_alerts": business.zscore_alerts,
    "rolling_deviation": business.rolling_deviation,
    "anomaly_context": business.anomaly_context,
    "monthly_kpis": business.monthly_kpis,
    "dow_revenue_stats": business.dow_revenue_stats,
    "revenue_ma": business.revenue_ma,
    "gt_listing": business.gt_listing,
    "daily_split": business.daily_split,
    "report_monthly_avg": business.report_monthly_avg,
    "ask_anomalies": questions.ask_anomalies,
    "ask_zscore": questions.ask_zscore,
    "ask_top_days": questions.ask_top_days,
    "ask_worst_days": questions.ask_worst_days,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.daily_kpis)

for _key, _op in {
    "cancel_rate": business.cancel_rate,
    "category_revenue": business.category_revenue,
    "category_pareto": business.category_pareto,
    "ask_category": questions.ask_category,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.category_values)


@register
def freight_by_weight(w):
    return business.freight_by_weight(w.fact_order_items, w.sources.products)


for _key, _op in {
    "state_segments": business.state_segments,
    "top_states": business.top_states,
    "ask_state": questions.ask_state,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.fact_orders, w.dim_customers)

for _key, _op in {
    "pareto_curve": business.pareto_curve,
    "top20_share": business.top20_share,
    "customer_split": business.customer_split,
}.items():
    QUERIES[_key] = lambda w, op=_op: op(w.dim_customers)


@register
def category_tree(w):
    return business.category_tree(w.dim_products)


@register
def category_head(w):
    """Categories that make up the first 80 % of revenue."""
    return business.category_pareto(w.category_values, upto=80)


@register
def kpi_cards(w):
    return business.kpi_cards(w.fact_orders, w.daily_kpis)


@register
def report_kpis(w):
    return business.report_kpis(w.fact_orders, w.daily_kpis, w.model_results)


@register
def order_value_box(w):
    """Five numbers of order value and the orders outside the 1.5 IQR fence, over all orders."""
    return business.order_value_box(w.fact_orders)


# --- questions ---


@register
def ask_status(w):
    return questions.ask_status(w.fact_orders_all)


@register
def ask_overview(w):
    return questions.ask_overview(w.fact_orders, w.daily_kpis, w.model_results)


@register
def question_intents(w):
    return questions.question_intents(w.table("conversations").filter(F.col("role") == "user"))


# --- quality ---


@register
def dq_report(w):
    return quality.dq_report(w.fact_orders_all, w.dim_customers)


@register
def dq_rules(w):
    tables = {
        "fact_orders": w.fact_orders, "dim_customers": w.dim_customers, "dim_products": w.dim_products,
        "daily_kpis": w.daily_kpis, "model_results": w.model_results,
    }
    return quality.dq_rules(tables, contract.LEAST_ROWS)


# --- events: batch twins, then the streams themselves ---


def _events(w) -> DataFrame:
    return w.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@register
def events_daily_kpis(w):
    return streaming.events_daily_kpis(_events(w), ["event_type"])


def _event_holidays(w) -> DataFrame:
    """Event whitelist: labelled days of the years that the events cover."""
    return holiday_calendar(w.spark, *calendar_years(w.table("events"), "ts"))


def _alerts(w, events: DataFrame) -> DataFrame:
    baseline = streaming.value_baseline(w.table("events"), ["event_type"])
    return streaming.alerts(events, baseline, ["event_type"], _event_holidays(w)).select(
        "event_id", "event_type", "order_date", "value", "z_score", "alert"
    )


@register
def events_alerts(w):
    return _alerts(w, _events(w))


def _event_stream(w) -> DataFrame:
    return streaming.read_event_stream(w.spark, w.sf_dir, "events.parquet")


@register
def stream_alerts(w):
    return streaming.drain(_alerts(w, _event_stream(w)), "stream_alerts")


@register
def stream_daily_kpis(w):
    """Every day of the stream, also the last ones, which no watermark has closed yet."""
    days = streaming.stream_daily_kpis(_event_stream(w), ["event_type"])
    return streaming.drain_updates(days, ["event_type", "order_date"], "stream_daily_kpis").drop("approx_users")


@register
def stream_ewm(w):
    """Daily totals per event type, streamed one more time through the stateful z-score."""
    daily = streaming.events_daily_kpis(_events(w), ["event_type"]).select("event_type", "order_date", "daily_value")
    path = fresh_path(w.spark, "event_days")
    daily.write.parquet(path)
    days = w.spark.readStream.schema(daily.schema).parquet(path)
    out = streaming.drain(streaming.stream_ewm(days, "event_type", "daily_value", 7), "stream_ewm")
    return _rounded(out, 4, "score")


# --- baselines with a validity, met as of the day of a row ---


@register
def baseline_versions(w):
    """Mean and deviation of the 90 days before the first of every month, each valid for its month."""
    moments = baselines.daily_moments(w.daily_kpis, "daily_revenue")
    return _rounded(baselines.baseline_versions(moments), 4, "base_mean", "base_std")


@register
def asof_alerts(w):
    """Days far from the baseline that was in force on them; the labelled days never alert."""
    versions = baselines.baseline_versions(baselines.daily_moments(w.daily_kpis, "daily_revenue"))
    found = baselines.alerts_as_of(w.daily_kpis, versions, (), "daily_revenue", F.col("order_date"), w.calendar, 2.0)
    return found.select("order_date", "daily_revenue", "valid_from", "z_score", "alert")


_ASOF_COLUMNS = ("event_id", "event_type", "order_date", "value", "valid_from", "z_score", "alert")


def _event_moments(w) -> DataFrame:
    return baselines.daily_moments(_events(w), "value", ["event_type"], "ts")


@register
def events_asof_alerts(w):
    """Events against the 90 days before their own one, refreshed daily."""
    versions = baselines.baseline_versions(_event_moments(w), ["event_type"], every="day")
    events = _events(w).withColumn("order_date", F.to_date("ts"))
    date = F.col("order_date")
    return baselines.alerts_as_of(events, versions, ["event_type"], "value", date, _event_holidays(w)).select(*_ASOF_COLUMNS)


@register
def stream_asof_alerts(w):
    """The same over the stream: every micro-batch looks up the versions that are stored by then."""
    store = baselines.VersionStore(w.spark, series_key=["event_type"])
    store.refresh(_event_moments(w), every="day")
    events = _event_stream(w).withColumn("order_date", F.to_date("ts"))
    date = F.col("order_date")
    return monitor.drain_alerts(
        events, store.read, ["event_type"], "value", date, _event_holidays(w), columns=_ASOF_COLUMNS
    )


@register
def stream_ewm_ordered(w):
    """The streamed z-score with days that arrive out of order, up to two days late, in several micro-batches."""
    daily = streaming.events_daily_kpis(_events(w), ["event_type"]).select("event_type", "order_date", "daily_value")
    late = F.pmod(F.crc32(F.concat_ws("/", "event_type", "order_date").cast("binary")), F.lit(3)).cast("int")
    arrival = daily.withColumn("arrival", F.date_add("order_date", late))
    first, last = arrival.agg(F.min("arrival"), F.max("arrival")).head()
    path = fresh_path(w.spark, "late_days")
    step = ((last - first).days + 4) // 4 if first is not None else 1
    for part in range(4):  # four files in the order of arrival
        slot = F.floor(F.datediff("arrival", F.lit(first)) / step)
        arrival.filter(slot == part).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    ordered.closing_day(daily, "event_type", "daily_value", 3).coalesce(1).write.mode("append").parquet(path)
    ordered.use_rocksdb(w.spark)
    days = w.spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streaming.drain(ordered.ordered_ewm(days, "event_type", "daily_value", 7, "3 days"), "stream_ewm_ordered")
    return _rounded(out, 4, "score")


# --- mergeable sketches ---

_RANKS = (0.25, 0.5, 0.95)


def _month() -> Column:
    return F.date_format("order_date", "yyyy-MM")


def _period_quantiles(w) -> DataFrame:
    """Quantiles of order values per month and over all, from the daily sketches alone."""
    daily = w.order_value_sketches
    merged = sketches.merged_quantiles(daily, [_month().alias("period")])
    merged = merged.unionByName(sketches.merged_quantiles(daily, [F.lit("all").alias("period")]))
    return sketches.read_quantiles(merged, ["period"], _RANKS)


@register
def period_quantiles(w):
    """What a dashboard reads: no order is scanned, whatever the period."""
    return _rounded(_period_quantiles(w), 2, "estimate")


@register
def quantile_sketches(w):
    """Exact quantiles per period, and whether the sketched ones keep their rank within twice the documented error."""
    orders = w.fact_orders.select(F.col("order_value").cast("double").alias("v"), F.explode(F.array(_month(), F.lit("all"))).alias("period"))
    asked = _period_quantiles(w)
    misses = sketches.rank_misses(orders, ["period"], "v", asked)
    names = {quantile_name(r): r for r in _RANKS}
    exact = exact_quantiles_by(orders, ["period"], "v", _RANKS).unpivot(["period"], list(names), "name", "exact")
    rank = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("name")]
    exact = exact.select("period", rank.alias("rank"), F.round("exact", 4).alias("exact"))
    bound = 2 * sketches.rank_error()
    return asked.join(misses, ["period", "rank"]).join(exact, ["period", "rank"]).select(
        "period", "rank", "n", "exact", (F.col("miss") <= bound).alias("within_bound")
    )


@register
def distinct_customers(w):
    """Customers per week, month and over all: exact, and whether merged daily sketches come close."""
    periods = {"week": F.date_format(F.date_trunc("week", "order_date"), "yyyy-MM-dd"), "month": _month(), "all": F.lit("all")}
    grains = [F.struct(F.lit(g).alias("grain"), p.alias("period")) for g, p in periods.items()]
    grain = F.explode(F.array(*grains)).alias("g")
    exact = w.fact_orders.select("customer_id", grain).groupBy("g.grain", "g.period").agg(F.countDistinct("customer_id").alias("customers"))
    merged = sketches.merged_distinct(w.customer_sketches.select("sketch", grain), ["g.grain", "g.period"])
    return exact.join(merged, ["grain", "period"]).select(
        "grain", "period", "customers", sketches.close_to(F.col("estimate"), F.col("customers")).alias("within_bound")
    )


@register
def stream_distinct_users(w):
    """Users per event type and week from the daily sketches of the stream, which no later batch has to scan again."""
    events = _event_stream(w).withWatermark("ts", "1 day")
    days = sketches.distinct_sketches(events, [F.window("ts", "1 day"), "event_type"], "user_id")
    days = days.select("event_type", F.to_date("window.start").alias("order_date"), "sketch")
    daily = streaming.drain_updates(days, ["event_type", "order_date"], "stream_users")
    week = lambda day: F.date_format(F.date_trunc("week", day), "yyyy-MM-dd").alias("week")
    merged = sketches.merged_distinct(daily.select("event_type", week("order_date"), "sketch"), ["event_type", "week"])
    exact = _events(w).groupBy("event_type", week("ts")).agg(F.countDistinct("user_id").alias("users"))
    return exact.join(merged, ["event_type", "week"]).select(
        "event_type", "week", "users", sketches.close_to(F.col("estimate"), F.col("users")).alias("within_bound")
    )


@register
def little_bootstraps(w):
    """Intervals of the mean and the median order value per state, from subsets of n ** 0.6 orders."""
    out = hypothesis.little_bootstraps_ci(w.fact_orders, ["customer_state"], "order_value", ["order_id"])
    out = _rounded(out, 9, "ci_lower", "ci_upper")  # so that a tie does not depend on the order in which subsets are added
    return _rounded(out, 4, "estimate", "ci_lower", "ci_upper")


# --- order CSVs with faulty lines, and re-runs that write what changed ---


def _faulty_csvs(w) -> dict[str, str]:
    """The four order tables as CSV, and beside every 400th order and item faulty versions of it."""
    s = w.sources
    text = lambda df, **new: df.select(*[new.get(c, F.col(c).cast("string")).alias(c) for c in df.columns])
    orders = s.orders.select(
        "order_id", "customer_id", "order_status",
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp"),
    )
    items = s.items.select(
        "order_id", "order_item_id", "product_id", (F.col("price_cents") / 100).alias("price"),
        (F.col("freight_cents") / 100).alias("freight_value"),
    )
    products = s.products.withColumnsRenamed({"category": "product_category_name", "weight_g": "product_weight_g"})
    bad_orders, bad_items = orders.filter("order_id % 400 = 0"), items.filter("order_id % 400 = 0")
    none = F.lit(None).cast("string")
    tables = {
        "orders": text(orders)
        .unionByName(text(bad_orders, order_purchase_timestamp=F.lit("yesterday")))
        .unionByName(text(bad_orders, order_id=none)),
        "items": text(items)
        .unionByName(text(bad_items, price=F.lit("12,5 EUR")))
        .unionByName(text(bad_items, price=F.lit("-1.00")))
        .unionByName(text(bad_items, product_id=none)),
        "customers": text(s.customers),
        "products": text(products),
    }
    root = fresh_path(w.spark, "order_csv")
    for name, rows in tables.items():
        rows.write.option("header", True).csv(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in tables}


@register
def csv_star(w):
    """Order facts from CSV files with faulty lines: the same as from the tables."""
    good, _ = from_csv_checked(w.spark, _faulty_csvs(w))
    facts = star.build_fact_orders(good.orders, good.items, good.customers)
    return facts.withColumns({c: F.col(c).cast("bigint") for c in ("order_id", "customer_id")})


@register
def csv_rejects(w):
    """The faulty lines of the same files by table and reason."""
    _, rejects = from_csv_checked(w.spark, _faulty_csvs(w))
    return rejects.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rows"))


def _monthly_run(w) -> tuple[str, DataFrame]:
    """The facts written by month, then again with the orders of the last month a cent dearer; the folder, and per month
    its rows and whether the second run wrote it."""
    path = fresh_path(w.spark, "monthly_facts")
    facts = w.fact_orders
    incremental.write_changed_months(facts, path, "order_date")
    last = only_row(facts.agg(F.max(_month()).alias("last")))["last"]
    later = facts.withColumn("order_value", F.when(_month() == last, F.col("order_value") + F.lit(Decimal("0.01"))).otherwise(F.col("order_value")).cast("decimal(18,2)"))
    changed = incremental.write_changed_months(later, path, "order_date")
    months = incremental.read_months(w.spark, path, facts).groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_value").cast("double").alias("revenue")
    )
    return path, months.withColumn("rewritten", F.col("month").isin(changed))


@register
def changed_months(w):
    """A second run over facts of which one month changed writes that month alone."""
    return _monthly_run(w)[1]


@register
def table_listing(w):
    """Tables of a database with their columns and partitions, as the catalog lists them."""
    path, _ = _monthly_run(w)
    database = f"listing_{uuid.uuid4().hex}"
    w.spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(w.spark, 'database')}'")
    incremental.register_months(w.spark, database, "fact_orders", path, w.fact_orders)
    sinks.save_as_tables({"daily_kpis": w.daily_kpis, "dim_products": w.dim_products}, database)
    return incremental.table_listing(w.spark, database)
