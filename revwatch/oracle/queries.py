"""One SQL text per registered query that has a relational form."""

from __future__ import annotations

from revwatch.oracle.base import (
    band,
    cents,
    day,
    mean_pct,
    query,
    ratio,
    share,
)
from revwatch.oracle.constants import (
    DBSCAN_EPS,
    DBSCAN_MIN_SAMPLES,
    FEATURE_SETS,
    FOREST_CONTAMINATION,
    FOREST_SHARES,
    FOREST_SIZES,
    LOF_CONTAMINATION,
    LOF_NEIGHBORS,
    REQUIRED,
    RULES,
    SEASON_PERIODS,
    SERIES_FEATURES,
    SERIES_THRESHOLDS,
    SERIES_WINDOWS,
    SWEEP,
    ZSCORE_FEATURES,
    ZSCORE_THRESHOLDS,
    poisson_cumulated,
)

SQL: dict[str, str] = {}

MEAN_VALUE = ratio("sum(value_c)", "count(*)", 2, 1, 100)
MEAN_VALUE_0 = ratio("sum(value_c)", "count(*)", 0, 1, 100)
BILLABLE = "order_status NOT IN ('cancelled', 'unavailable')"
FACT_COLUMNS = f"""order_id, customer_id, {day()} AS order_date, order_status, {cents("value_c")} AS order_value,
  {cents("freight_c")} AS freight_value, items_count, unique_products, city AS customer_city, state AS customer_state"""


def _avg_cents(expr: str, n: str, digits: int = 2) -> str:
    return ratio(expr, n, digits, 1, 100)


# --- sources ---
SQL["src_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
    for t in REQUIRED
)
SQL["contract_check"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, {len(cols)} AS expected_columns, CAST(0 AS BIGINT) AS violations, count(*) AS rows,
    count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in cols)}) AS incomplete_rows FROM {t}"""
    for t, cols in REQUIRED.items()
)
SQL["csv_roundtrip"] = """SELECT method_type, count(*) AS configs, CAST(sum(anomalies_detected) AS BIGINT) AS anomalies,
  CAST(sum(true_positives) AS BIGINT) AS true_positives FROM results GROUP BY 1"""
SQL["sink_roundtrip"] = f"""SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders,
  {cents("sum(value_c)")} AS revenue FROM fact GROUP BY 1"""

# --- star schema ---
SQL["order_dates"] = f"SELECT {day()} AS order_date, count(*) AS orders FROM all_orders GROUP BY 1"
SQL["valid_orders"] = f"""SELECT order_id, customer_id, order_status, {day()} AS order_date FROM all_orders
  WHERE order_status IN ('delivered', 'shipped', 'invoiced', 'processing')"""
SQL["order_totals"] = f"""SELECT order_id, {cents("value_c")} AS order_value, {cents("freight_c")} AS freight_value,
  items_count, unique_products FROM totals"""
SQL["fact_orders"] = f"SELECT {FACT_COLUMNS} FROM fact"
SQL["dim_customers"] = f"""SELECT customer_id, city, state, total_orders, {cents("spent_c")} AS total_spent,
  {_avg_cents("spent_c", "total_orders")} AS avg_order_value, {day("first_purchase")} AS first_purchase,
  {day("last_purchase")} AS last_purchase, tier FROM customers"""
SQL["dim_products"] = f"""SELECT product_id, category, weight_g, qty AS total_qty_sold, {cents("revenue_c")} AS total_revenue,
  {_avg_cents("revenue_c", "qty")} AS avg_price, {_avg_cents("freight_c", "qty")} AS avg_freight FROM sold"""
SQL["spend_quantiles"] = "SELECT " + ", ".join(
    f"round(quantile_cont(spent_c / 100.0, {p}), 4) AS {n}" for p, n in ((0.75, "q75"), (0.95, "q95"), (0.99, "q99"))
) + " FROM spend"
SQL["tier_counts"] = "SELECT tier, count(*) AS customers FROM customers GROUP BY tier"
SQL["orphan_customers"] = """SELECT DISTINCT f.customer_id FROM fact_all f ANTI JOIN customers c
  ON f.customer_id = c.customer_id"""


def _describe(name: str, column: str, unit: int) -> str:
    expr = f"CAST({column} AS DOUBLE) / {unit}"
    cuts = ", ".join(f"round(quantile_cont({expr}, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"""SELECT '{name}' AS "column", count(*) AS count, {ratio(f"sum({column})", "count(*)", 4, 1, unit)} AS mean,
  round(stddev_samp({expr}), 4) AS stddev, min({expr}) AS min, {cuts}, max({expr}) AS max FROM fact"""


SQL["order_summary"] = " UNION ALL ".join(
    _describe(*c)
    for c in (
        ("order_value", "value_c", 100), ("freight_value", "freight_c", 100), ("items_count", "items_count", 1),
        ("unique_products", "unique_products", 1),
    )
)

# --- KPI series ---
_DAILY = "daily_revenue, order_count, avg_order_value, avg_freight, unique_customers, z_score, anomaly_flag"
SQL["daily_kpis"] = f"SELECT {day()} AS order_date, {_DAILY} FROM daily"
SQL["daily_kpis_by_state"] = f"SELECT state, {day()} AS order_date, {_DAILY} FROM daily_state"
SQL["label_events"] = f"SELECT {day()} AS order_date, {_DAILY}, is_true_anomaly, event_label FROM labelled"
SQL["ground_truth"] = f"""SELECT {day()} AS anomaly_date, event_label,
  coalesce(type, CASE WHEN z_score > 0 THEN 'spike' ELSE 'drop' END) AS anomaly_type,
  coalesce(severity, 'high') AS severity FROM labelled WHERE is_true_anomaly = 1"""
SQL["etl_metrics"] = """
  SELECT 'orders_kept' AS metric, count(*) FILTER (WHERE order_status IN ('delivered', 'shipped')) AS value FROM all_orders
  UNION ALL SELECT 'orders_removed', count(*) FILTER (WHERE order_status NOT IN ('delivered', 'shipped')) FROM all_orders
  UNION ALL SELECT 'fact_orders', count(*) FROM fact
  UNION ALL SELECT 'date_span_days', date_diff('day', min(order_date), max(order_date)) FROM fact
  UNION ALL SELECT 'products', count(*) FROM sold
  UNION ALL SELECT 'product_categories', count(DISTINCT category) FROM sold
  UNION ALL SELECT 'days', count(*) FROM labelled
  UNION ALL SELECT 'flagged_days', CAST(sum(anomaly_flag) AS BIGINT) FROM labelled
  UNION ALL SELECT 'labelled_days', CAST(sum(is_true_anomaly) AS BIGINT) FROM labelled
  UNION ALL SELECT 'extreme_days', count(*) FILTER (WHERE event_label = 'Extreme statistical outlier') FROM labelled
  UNION ALL SELECT 'calendar_days', count(*) FROM calendar WHERE event_date IN (SELECT order_date FROM labelled)"""
_W90 = "(ORDER BY order_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)"
SQL["baseline_90d"] = f"""SELECT {day()} AS order_date, daily_revenue,
  {ratio(f"sum(rev_c) OVER {_W90}", f"count(*) OVER {_W90}", 4, 1, 100)} AS baseline_mean,
  round(stddev_samp(daily_revenue) OVER {_W90}, 4) AS baseline_std, count(*) OVER {_W90} AS baseline_days FROM daily"""
_WM = "(PARTITION BY month(order_date))"
SQL["seasonal_z"] = f"""SELECT {day()} AS order_date, daily_revenue, strftime(order_date, '%m') AS month_num,
  round((daily_revenue - avg(daily_revenue) OVER {_WM}) / nullif(stddev_samp(daily_revenue) OVER {_WM}, 0), 4)
    AS seasonal_z FROM daily"""

# --- features ---
_FEATURES = (
    "daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_ma30", "revenue_std7",
    "orders_ma7", "revenue_diff", "revenue_pct_change", "day_of_week",
)
SQL["features"] = f"SELECT {day()} AS order_date, is_true_anomaly, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _FEATURES
) + " FROM features"
_BASE = _FEATURES[:4]
SQL["scale_standard"] = f"SELECT {day()} AS order_date, " + ", ".join(
    f"round(coalesce((f.{c} - avg(f.{c}) OVER ()) / nullif(stddev_pop(f.{c}) OVER (), 0), 0), 9) AS {c}" for c in _BASE
) + " FROM features f"
SQL["scale_minmax"] = f"SELECT {day()} AS order_date, " + ", ".join(
    f"round(coalesce((f.{c} - min(f.{c}) OVER ()) / nullif(max(f.{c}) OVER () - min(f.{c}) OVER (), 0), 0), 9) AS {c}"
    for c in _BASE
) + " FROM features f"
SQL["scale_robust"] = f"SELECT {day()} AS order_date, " + ", ".join(
    f"round((f.{c} - q.{c}[2]) / coalesce(nullif(q.{c}[3] - q.{c}[1], 0), 1), 9) AS {c}" for c in _BASE
) + " FROM features f, (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}" for c in _BASE) + " FROM features) q"

# --- grid ---
for _key, _cte in {
    "grid_zscore": "grid_zscore", "grid_rolling_z": "grid_rolling_z", "grid_ewm": "grid_ewm",
    "grid_seasonal_resid": "grid_seasonal", "grid_iqr": "grid_iqr", "grid_mad": "grid_mad", "grid_lof": "grid_lof",
    "grid_dbscan": "grid_dbscan", "grid_iforest": "grid_forest", "model_results": "results",
}.items():
    SQL[_key] = f"SELECT * FROM {_cte}"

_STATE_PART = "PARTITION BY state"


def _state_mean(col: str, unit: str = "") -> str:
    w = f"({_STATE_PART} ORDER BY order_date ROWS 6 PRECEDING)"
    return f"CAST(sum({col}) OVER {w} AS DOUBLE){unit} / count(*) OVER {w}"


_STATE_LONG = " UNION ALL ".join(
    f"SELECT state, '{c}' AS feature_set, truth, {c} AS x FROM sf"
    for c in ("daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_diff")
)
SQL["grid_zscore_by_state"] = f"""
  SELECT state, 'Z_t' || CAST(t AS VARCHAR) AS model, feature_set, n AS anomalies_detected, pct AS anomaly_pct, total_days,
         tp AS true_positives, CASE WHEN pct BETWEEN 1 AND 15 THEN 'yes' ELSE 'no' END AS success
  FROM (SELECT *, {ratio("n", "total_days", 1, 100)} AS pct FROM (
    SELECT state, feature_set, t, count(*) FILTER (WHERE score > t) AS n,
           count(*) FILTER (WHERE score > t AND truth = 1) AS tp, count(*) AS total_days
    FROM (SELECT *, abs((x - avg(x) OVER (PARTITION BY state, feature_set))
                        / nullif(stddev_samp(x) OVER (PARTITION BY state, feature_set), 0)) AS score
          FROM (WITH sf AS (
                  SELECT state, CAST(c.label IS NOT NULL OR coalesce(abs(z_score) > 3.5, false) AS INTEGER) AS truth,
                         daily_revenue, CAST(order_count AS DOUBLE) AS order_count, avg_order_value, avg_freight,
                         {_state_mean("rev_c", " / 100")} AS revenue_ma7,
                         coalesce(CAST(rev_c - lag(rev_c) OVER ({_STATE_PART} ORDER BY order_date) AS DOUBLE) / 100, 0)
                           AS revenue_diff
                  FROM daily_state LEFT JOIN calendar c ON order_date = c.event_date)
                {_STATE_LONG})),
         (SELECT unnest([CAST(1.5 AS DOUBLE), 1.75, 2, 2.25, 2.5, 2.75, 3, 3.5, 4]) AS t)
    GROUP BY ALL))"""
_DEFINED = {
    "IsolationForest": len(FOREST_CONTAMINATION) * len(FOREST_SIZES) * len(FOREST_SHARES) * len(FEATURE_SETS),
    "LocalOutlierFactor": len(LOF_NEIGHBORS) * len(LOF_CONTAMINATION) * len(FEATURE_SETS),
    "DBSCAN": len(DBSCAN_EPS) * len(DBSCAN_MIN_SAMPLES) * len(FEATURE_SETS),
    "ZScore": len(ZSCORE_THRESHOLDS) * len(ZSCORE_FEATURES),
    "RollingZScore": len(SERIES_WINDOWS) * len(SERIES_THRESHOLDS) * len(SERIES_FEATURES),
    "STL_Residual": len(SEASON_PERIODS) * len(SERIES_THRESHOLDS) * len(SERIES_FEATURES),
    "EWM_ZScore": len(SERIES_WINDOWS) * len(SERIES_THRESHOLDS) * len(SERIES_FEATURES),
}
SQL["grid_size"] = f"""SELECT method_type, coalesce(configs, 0) AS configs, total_days, CAST(coalesce(n, 0) AS BIGINT) AS defined_configs
  FROM (VALUES {", ".join(f"('{m}', {n})" for m, n in _DEFINED.items())}) d(method_type, n)
  FULL JOIN (SELECT method_type, count(*) AS configs, max(total_days) AS total_days FROM results GROUP BY method_type) r USING (method_type)"""
SQL["grid_summary"] = """SELECT count(*) AS configs, count(*) FILTER (WHERE success = 'yes') AS successful,
  max(true_positives) AS best_true_positives, count(DISTINCT method_type) AS methods FROM results"""
SQL["sigma_band"] = f"""SELECT {day()} AS order_date, daily_revenue, round(lo, 4) AS lower_limit, round(hi, 4) AS upper_limit
  FROM daily, (SELECT avg(daily_revenue) - 2.5 * stddev_samp(daily_revenue) AS lo,
                      avg(daily_revenue) + 2.5 * stddev_samp(daily_revenue) AS hi FROM daily)
  WHERE daily_revenue > hi OR daily_revenue < lo"""
_METRICS = ("daily_revenue", "order_count", "avg_order_value", "avg_freight")
SQL["alert_driver"] = f"""SELECT {day()} AS order_date, driver, z AS driver_z FROM (
  SELECT order_date, driver, z, row_number() OVER (PARTITION BY order_date ORDER BY abs(z) DESC, i) AS rn FROM (""" + \
  " UNION ALL ".join(
    f"""SELECT order_date, anomaly_flag, {i} AS i, '{m}' AS driver,
        round(({m} - avg({m}) OVER ()) / stddev_samp({m}) OVER (), 6) AS z FROM daily""" for i, m in enumerate(_METRICS)
) + ") WHERE anomaly_flag = 1) WHERE rn = 1"
_LOF20 = "(SELECT order_date, truth, score FROM lof_scores WHERE feature_set = 'multi_feature' AND n_neighbors = 20)"
_FOREST200 = """(SELECT order_date, truth, score FROM forest_scores
  WHERE feature_set = 'multi_feature' AND max_features = 1.0 AND n_estimators = 200)"""
for _key, _source in (("ensemble_alerts", _LOF20), ("ensemble_alerts_iforest", _FOREST200)):
    SQL[_key] = f"""SELECT {day("d.order_date")} AS order_date, daily_revenue, z_score, round(score, 4) AS score
  FROM daily d JOIN {_source} l ON d.order_date = l.order_date,
       (SELECT quantile_cont(-round(score, 6), 0.05) AS cut FROM {_source})
  WHERE anomaly_flag = 1 AND -round(score, 6) < cut"""

# --- evaluation ---


def _zero(num: str, den: str) -> str:
    return f"coalesce({ratio(num, den, 4)}, 0)"


def _metrics(prefix: str, cells: str) -> str:
    """Eleven metrics of rows holding tp, fp, tn, fn."""
    return f"""SELECT {prefix}, {_zero("tp", "(tp + fp)")} AS precision, {_zero("tp", "(tp + fn)")} AS recall,
  {_zero("(2 * tp)", "(2 * tp + fp + fn)")} AS f1_score, {_zero("tn", "(tn + fp)")} AS specificity,
  {_zero("fp", "(fp + tn)")} AS false_positive_rate, tp AS true_positives, fp AS false_positives,
  tn AS true_negatives, fn AS false_negatives, tp + fp AS total_flagged, tp + fn AS total_anomalies FROM ({cells})"""


def _cells(truth: str, pred: str) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {truth} = {t} AND {'' if p else 'NOT '}coalesce({pred}, false)) AS {n}"
        for n, t, p in (("tp", 1, True), ("fp", 0, True), ("tn", 0, False), ("fn", 1, False))
    )


SQL["eval_detector"] = _metrics("method", f"SELECT 'ZScore' AS method, {_cells('is_true_anomaly', 'anomaly_flag = 1')} FROM labelled")
_ONE = "feature_set = 'daily_revenue'"
SQL["eval_all_methods"] = _metrics(
    "method",
    " UNION ALL ".join(
        [
            f"SELECT 'ZScore' AS method, {_cells('is_true_anomaly', 'anomaly_flag = 1')} FROM labelled",
            f"SELECT 'RollingZScore', {_cells('truth', 'score > 2.5')} FROM rolling_scores WHERE {_ONE} AND win = 30",
            f"SELECT 'EWM_ZScore', {_cells('truth', 'score > 2.5')} FROM ewm_scores WHERE {_ONE} AND span = 30",
            f"SELECT 'IQR', {_cells('truth', 'score > 1.5')} FROM iqr_scores WHERE {_ONE}",
            f"SELECT 'MAD', {_cells('truth', 'score > 3.0')} FROM mad_scores WHERE {_ONE}",
        ]
    ),
)
_SWEEP = _metrics(
    "threshold",
    f"""SELECT threshold, {_cells("is_true_anomaly", "abs(z_score) > threshold")} FROM labelled,
    (SELECT unnest([{", ".join(f"CAST({t} AS DOUBLE)" for t in SWEEP)}]) AS threshold) GROUP BY threshold""",
)
SQL["threshold_sweep"] = _SWEEP
SQL["best_threshold"] = f"SELECT * FROM ({_SWEEP}) ORDER BY f1_score DESC, threshold LIMIT 1"
SQL["eval_report"] = f"""SELECT threshold, precision, recall, f1_score, total_flagged,
  (SELECT count(*) FROM labelled) AS days, (SELECT CAST(sum(is_true_anomaly) AS BIGINT) FROM labelled) AS anomaly_days,
  (SELECT count(*) FROM labelled WHERE is_true_anomaly = 0) AS normal_days,
  CAST(row_number() OVER (ORDER BY f1_score DESC, threshold) = 1 AS INTEGER) AS is_optimum FROM ({_SWEEP})"""
_SCORES = f"""SELECT 'ZScore' AS method, order_date, is_true_anomaly, abs(z_score) AS score FROM labelled
  UNION ALL SELECT 'LocalOutlierFactor', order_date, truth, round(score, 9) FROM {_LOF20}
  UNION ALL SELECT 'IsolationForest', order_date, truth, round(score, 9) FROM {_FOREST200}"""
SQL["anomaly_scores"] = f"SELECT method, {day()} AS order_date, is_true_anomaly, round(score, 6) AS score FROM ({_SCORES})"
SQL["anomaly_scores_all"] = SQL["anomaly_scores"]
_CUM = f"""SELECT method, score, row_number() OVER w AS point, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY method) AS positives, sum(neg) OVER (PARTITION BY method) AS negatives
  FROM (SELECT method, score, count(*) FILTER (WHERE is_true_anomaly = 1) AS pos,
               count(*) FILTER (WHERE is_true_anomaly = 0) AS neg FROM ({_SCORES}) GROUP BY method, score)
  WINDOW w AS (PARTITION BY method ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""
_ROC = f"""SELECT method, point, score, CAST(fp AS DOUBLE) / negatives AS fpr, CAST(tp AS DOUBLE) / positives AS tpr FROM ({_CUM})
  UNION ALL SELECT DISTINCT method, 0, CAST(NULL AS DOUBLE), 0, 0 FROM ({_SCORES})"""
_PR = f"""SELECT method, point, score, CAST(tp AS DOUBLE) / positives AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision
  FROM ({_CUM}) UNION ALL SELECT DISTINCT method, 0, CAST(NULL AS DOUBLE), 0, 1 FROM ({_SCORES})"""
SQL["roc_curve"] = f"SELECT method, point, round(score, 6) AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ({_ROC})"
SQL["pr_curve"] = f"SELECT method, point, round(score, 6) AS score, round(recall, 6) AS recall, round(precision, 6) AS precision FROM ({_PR})"


def _area(curve: str, x: str, y: str, name: str) -> str:
    w = "(PARTITION BY method ORDER BY point)"
    return f"""SELECT method, round(sum(area), 6) AS {name} FROM (
      SELECT method, ({x} - lag({x}) OVER {w}) * ({y} + lag({y}) OVER {w}) / 2 AS area FROM ({curve})) GROUP BY method"""


SQL["roc_auc"] = _area(_ROC, "fpr", "tpr", "roc_auc")
SQL["pr_auc"] = _area(_PR, "recall", "precision", "pr_auc")
SQL["auc_all"] = f"SELECT * FROM ({SQL['roc_auc']}) JOIN ({SQL['pr_auc']}) USING (method)"

# --- root-cause tables ---
_CLASS = """CASE WHEN anomaly_pct < 1 THEN 'too_conservative' WHEN anomaly_pct < 3 THEN 'conservative'
  WHEN anomaly_pct <= 10 THEN 'reasonable' WHEN anomaly_pct <= 20 THEN 'aggressive' ELSE 'broken' END"""
SQL["rate_class"] = f"""SELECT model, method_type, feature_set, anomaly_pct, {_CLASS} AS rate_class,
  CASE WHEN {band()} THEN 'reasonable' WHEN anomaly_pct > 20 THEN 'broken' ELSE 'suboptimal' END AS quality FROM results"""
_PATTERNS = {
    "eps": r"eps([\d.]+)", "min_samples": r"ms(\d+)", "contamination": r"c(0\.\d+)", "n_neighbors": r"_k(\d+)",
    "n_estimators": r"_n(\d+)", "max_features": r"_mf([\d.]+)", "threshold": r"_t([\d.]+)", "window": r"_w(\d+)",
    "period": r"_p(\d+)", "span": r"_s(\d+)",
}


def _param(name: str) -> str:
    return f"CAST(nullif(regexp_extract(model, '{_PATTERNS[name]}', 1), '') AS DOUBLE)"


SQL["parse_model_params"] = "SELECT model, method_type, feature_set, " + ", ".join(
    f'{_param(p)} AS "{p}"' for p in _PATTERNS
) + " FROM results"
_MM = "min(anomaly_pct) AS min_anomaly_pct, max(anomaly_pct) AS max_anomaly_pct"
SQL["rca_method"] = f"""SELECT method_type, count(*) AS total_configs, count(*) FILTER (WHERE {band()}) AS reasonable_configs,
  count(*) FILTER (WHERE anomaly_pct > 20) AS broken_configs, {mean_pct()} AS avg_anomaly_pct, {_MM},
  round(stddev_samp(anomaly_pct), 2) AS std_anomaly_pct, {share(band())} AS success_rate_pct,
  {share("anomaly_pct > 20")} AS failure_rate_pct FROM results GROUP BY method_type"""
SQL["rca_feature_set"] = f"""SELECT feature_set, count(*) AS total_configs, {share(band())} AS reasonable_pct,
  {share("anomaly_pct > 20")} AS broken_pct, {mean_pct()} AS avg_anomaly_pct, max(n_features) AS n_features_used
  FROM results WHERE method_type NOT LIKE '%Statistical%' GROUP BY feature_set"""
SQL["rca_scaler"] = f"""SELECT scaler, method_type, count(*) AS total, count(*) FILTER (WHERE {band()}) AS reasonable,
  count(*) FILTER (WHERE anomaly_pct > 20) AS broken, {mean_pct()} AS avg_pct, {share(band())} AS success_rate
  FROM results WHERE method_type NOT LIKE '%Statistical%' GROUP BY scaler, method_type"""
SQL["rca_dbscan"] = f"""SELECT feature_set, scaler, eps, {mean_pct()} AS avg_anomaly_pct, max(anomaly_pct) AS max_anomaly_pct,
  count(*) FILTER (WHERE anomaly_pct >= 50) AS configs_over_50, count(*) AS configs
  FROM grid_dbscan GROUP BY feature_set, scaler, eps"""
SQL["rca_param_failure"] = f"""SELECT method_type, param, value, {mean_pct()} AS avg_anomaly_pct,
  count(*) FILTER (WHERE anomaly_pct > 20) AS broken_count, count(*) AS total, {share("anomaly_pct > 20")} AS failure_rate
  FROM (""" + " UNION ALL ".join(
    f"SELECT method_type, '{p}' AS param, {_param(p)} AS value, anomaly_pct FROM results" for p in _PATTERNS
) + ") WHERE value IS NOT NULL GROUP BY method_type, param, value"
_GAP = "abs(CAST(round(anomaly_pct * 10) AS INTEGER) - 50)"
SQL["rca_best"] = f"""SELECT model, method_type, feature_set, scaler, n_features, anomaly_pct FROM results
  WHERE anomaly_pct BETWEEN 4 AND 6
  QUALIFY row_number() OVER (PARTITION BY method_type ORDER BY {_GAP}, model, feature_set) <= 3"""
SQL["rca_contamination"] = f"""SELECT method_type, contamination, {mean_pct()} AS avg_anomaly_pct,
  round(stddev_samp(anomaly_pct), 2) AS std_anomaly_pct, count(*) AS configs
  FROM results WHERE contamination IS NOT NULL GROUP BY method_type, contamination"""
_AVG_TP = ratio("sum(true_positives)", "count(*)", 1)
SQL["ts_vs_static"] = f"""SELECT CASE WHEN method_type IN ('RollingZScore', 'EWM_ZScore', 'STL_Residual', 'SeasonalResidual')
  THEN 'time_series' ELSE 'static' END AS family, count(*) AS configs, max(true_positives) AS best_tp, {_AVG_TP} AS avg_tp
  FROM results GROUP BY 1"""
SQL["method_tp_summary"] = f"""SELECT method_type, count(*) AS total_configs, {share("success = 'yes'")} AS success_rate,
  {mean_pct(1)} AS avg_anomaly_pct, max(true_positives) AS max_true_positives, {_AVG_TP} AS avg_true_positives
  FROM results GROUP BY method_type"""
SQL["model_cards"] = f"""SELECT count(*) AS tested, count(*) FILTER (WHERE {band()}) AS working, {share(band(), 0)} AS working_pct,
  count(*) FILTER (WHERE anomaly_pct > 20) AS broken, {share("anomaly_pct > 20", 0)} AS broken_pct,
  count(DISTINCT method_type) AS methods FROM results"""
SQL["method_success"] = f"""SELECT method_type, count(*) AS configs, count(*) FILTER (WHERE {band()}) AS success,
  {share(band())} AS success_rate, {mean_pct(1)} AS avg_anomaly_pct, {share("anomaly_pct > 20")} AS broken_pct
  FROM results GROUP BY method_type"""
SQL["feature_bubble"] = f"""SELECT feature_set, {mean_pct(1)} AS avg_anomaly,
  count(*) FILTER (WHERE anomaly_pct > 20) AS broken, max(n_features) AS n_features FROM results GROUP BY feature_set"""
_PIVOT = (
    "IsolationForest", "LocalOutlierFactor", "DBSCAN", "ZScore", "RollingZScore", "EWM_ZScore", "SeasonalResidual", "IQR",
    "MAD",
)
SQL["heatmap_pivot"] = "SELECT feature_set, " + ", ".join(
    f"""max(a) FILTER (WHERE method_type = '{m}') AS "{m}_avg_pct", max(s) FILTER (WHERE method_type = '{m}') AS "{m}_success_rate\""""
    for m in _PIVOT
) + f""" FROM (SELECT feature_set, method_type, {mean_pct(1)} AS a, {share(band())} AS s FROM results
  GROUP BY feature_set, method_type) GROUP BY feature_set"""
SQL["best_config"] = f"""SELECT method_type, model, feature_set, scaler, anomaly_pct,
  CAST({_GAP} AS DOUBLE) / 10 AS deviation_from_5pct_target FROM results
  QUALIFY row_number() OVER (PARTITION BY method_type ORDER BY {_GAP}, model, feature_set) = 1"""
SQL["feature_effectiveness"] = f"""SELECT method_type, feature_set, count(*) AS configs_tested,
  count(*) FILTER (WHERE {band()}) AS reasonable_configs, {share(band())} AS success_rate_pct
  FROM results GROUP BY method_type, feature_set HAVING count(*) > 5
  ORDER BY success_rate_pct DESC, method_type, feature_set LIMIT 20"""
SQL["boxplot_stats"] = """SELECT method_type, round(any_value(q[1]), 4) AS low, round(any_value(q[2]), 4) AS q1,
  round(any_value(q[3]), 4) AS median, round(any_value(q[4]), 4) AS q3, round(any_value(q[5]), 4) AS high,
  count(*) FILTER (WHERE anomaly_pct < q[2] - (q[4] - q[2]) * 1.5 OR anomaly_pct > q[4] + (q[4] - q[2]) * 1.5) AS outliers
  FROM results JOIN (SELECT method_type, quantile_cont(anomaly_pct, [0, 0.25, 0.5, 0.75, 1]) AS q FROM results
                     GROUP BY method_type) USING (method_type) GROUP BY method_type"""
SQL["ask_models"] = f"""SELECT method_type, count(*) AS configs_tested, {share(band())} AS success_rate_pct,
  {mean_pct(1)} AS avg_anomaly_pct FROM results GROUP BY method_type"""
SQL["ask_features"] = f"""SELECT feature_set, scaler, count(*) AS configs, {share(band())} AS success_rate_pct,
  {mean_pct(1)} AS avg_anomaly_pct FROM results WHERE method_type NOT LIKE 'Statistical%' GROUP BY feature_set, scaler
  ORDER BY success_rate_pct DESC, feature_set, scaler LIMIT 15"""

# --- statistics ---
_REASONABLE = f"CAST({band()} AS INTEGER)"
_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
SQL["bootstrap_ci"] = f"""
  SELECT method_type, n, round(estimate, 6) AS estimate, round(ci[1], 6) AS ci_lower, round(ci[2], 6) AS ci_upper
  FROM (SELECT method_type, count(*) AS n, avg({_REASONABLE}) AS estimate FROM results GROUP BY 1 HAVING count(*) >= 10)
  JOIN (SELECT method_type, quantile_cont(stat, [0.025, 0.975]) AS ci FROM (
    WITH numbered AS (
      SELECT method_type, {_REASONABLE} AS x, count(*) OVER (PARTITION BY method_type) AS n,
             row_number() OVER (PARTITION BY method_type ORDER BY model, feature_set) - 1 AS i FROM results)
    SELECT d.method_type, d.b, avg(r.x) AS stat
    FROM (SELECT method_type, b, {_HEX.format("concat_ws('-', 42, b, i)")} % n AS pick FROM numbered, range(2000) t(b)) d
    JOIN numbered r ON r.method_type = d.method_type AND r.i = d.pick GROUP BY ALL) GROUP BY method_type)
  USING (method_type)"""
_WEIGHT = " + ".join(f"CAST(u >= CAST({c!r} AS DOUBLE) AS INTEGER)" for c in poisson_cumulated())
SQL["bootstrap_ci_poisson"] = f"""
  SELECT method_type, n, round(estimate, 6) AS estimate, round(ci[1], 6) AS ci_lower, round(ci[2], 6) AS ci_upper
  FROM (SELECT method_type, count(*) AS n, avg({_REASONABLE}) AS estimate FROM results GROUP BY 1 HAVING count(*) >= 10)
  JOIN (SELECT method_type, quantile_cont(stat, [0.025, 0.975]) AS ci FROM (
    SELECT method_type, b, CAST(sum(w * x) AS DOUBLE) / nullif(sum(w), 0) AS stat FROM (
      SELECT method_type, b, x, {_WEIGHT} AS w FROM (
        SELECT method_type, b, {_REASONABLE} AS x,
               {_HEX.format("concat_ws('-', 42, b, model, feature_set)")} / CAST(4294967296 AS DOUBLE) AS u
        FROM results, range(2000) t(b))) GROUP BY ALL) GROUP BY method_type) USING (method_type)"""

# Tail probabilities by Simpson's rule over the density, from 0 to the statistic.
_STEPS = 20000
_T_DENSITY = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2)"
_N_DENSITY = "exp(-x * x / 2) / sqrt(2 * pi())"
_C_DENSITY = "CASE WHEN x = 0 THEN 0 ELSE exp((df / 2 - 1) * ln(x) - x / 2 - df / 2 * ln(2) - lgamma(df / 2)) END"


def _tail(columns: str, source: str, upto: str, density: str, sides: int) -> str:
    return f"""SELECT {columns}, round(greatest(1 - {sides} * sum(density * k) * any_value(h) / 3, 0), 6) AS p_value FROM (
      SELECT *, {density} AS density FROM (
        SELECT *, {upto} / {_STEPS} AS h, i * ({upto}) / {_STEPS} AS x,
               CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS k
        FROM ({source}), range({_STEPS + 1}) r(i))) GROUP BY ALL"""


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_PAIRED = f"""SELECT avg(d) * 100 AS improvement_pct, count(*) AS n_pairs,
    avg(d) / sqrt(var_samp(d) / count(*)) AS t, CAST(count(*) - 1 AS DOUBLE) AS df
  FROM (SELECT b.m - a.m AS d
        FROM (SELECT model, scaler, avg({_REASONABLE}) AS m FROM results WHERE feature_set = 'revenue_only' GROUP BY 1, 2) a
        JOIN (SELECT model, scaler, avg({_REASONABLE}) AS m FROM results
              WHERE feature_set IN ('multi_feature', 'all_features') GROUP BY 1, 2) b USING (model, scaler))"""
SQL["paired_ttest"] = f"SELECT {_round('improvement_pct', 't')}, n_pairs, df, p_value FROM (" + _tail(
    "improvement_pct, n_pairs, t, df", _PAIRED, "abs(t)", _T_DENSITY, 2
) + ")"
_ONE_SAMPLE = f"""SELECT avg(x) AS mean, count(*) AS n, (avg(x) - 0.5) / sqrt(var_samp(x) / count(*)) AS t,
  CAST(count(*) - 1 AS DOUBLE) AS df FROM (SELECT {_REASONABLE} AS x FROM grid_dbscan)"""
SQL["one_sample_ttest"] = f"SELECT {_round('mean', 't')}, n, df, p_value FROM (" + _tail(
    "mean, n, t, df", _ONE_SAMPLE, "abs(t)", _T_DENSITY, 2
) + ")"
_CHI = f"""SELECT sum((o - e) * (o - e) / e) AS chi2, CAST(any_value(dof) AS DOUBLE) AS df, any_value(n) AS n FROM (
  SELECT o, n, dof, CAST(row_total AS DOUBLE) * sum(o) OVER (PARTITION BY c) / n AS e FROM (
    SELECT c, o, row_total, sum(o) OVER () AS n, (SELECT count(DISTINCT method_type) - 1 FROM results) AS dof
    FROM (SELECT method_type, c, count(*) FILTER (WHERE ({_REASONABLE}) = c) AS o, count(*) AS row_total
          FROM results, (VALUES (0), (1)) v(c) GROUP BY method_type, c)))"""
SQL["chi_square"] = "SELECT round(chi2, 6) AS chi2, CAST(df AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, p_value FROM (" + _tail(
    "chi2, df, n", _CHI, "least(chi2, 400)", _C_DENSITY, 1
) + ")"
SQL["contingency"] = f"""SELECT method_type, count(*) FILTER (WHERE NOT ({band()})) AS failures,
  count(*) FILTER (WHERE {band()}) AS successes FROM results GROUP BY method_type"""
_WELCH = """SELECT ma AS mean_a, na AS n_a, mb AS mean_b, nb AS n_b, (ma - mb) / sqrt(va / na + vb / nb) AS t,
    pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df
  FROM (SELECT avg(daily_revenue) FILTER (WHERE f) AS ma, var_samp(daily_revenue) FILTER (WHERE f) AS va,
               count(*) FILTER (WHERE f) AS na, avg(daily_revenue) FILTER (WHERE NOT f) AS mb,
               var_samp(daily_revenue) FILTER (WHERE NOT f) AS vb, count(*) FILTER (WHERE NOT f) AS nb
        FROM (SELECT daily_revenue, abs(z_score) > 2.5 AS f FROM daily))"""
SQL["welch_ttest"] = f"SELECT {_round('mean_a', 'mean_b', 't', 'df')}, n_a, n_b, p_value FROM (" + _tail(
    "mean_a, n_a, mean_b, n_b, t, df", _WELCH, "abs(t)", _T_DENSITY, 2
) + ")"
_MW = """SELECT u, n1 AS n_a, n2 AS n_b, median_a, median_b,
    greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0)
      / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
  FROM (SELECT sum(rk) FILTER (WHERE a) - n1 * (n1 + 1) / 2.0 AS u, n1, n2, ties,
               median(v) FILTER (WHERE a) AS median_a, median(v) FILTER (WHERE NOT a) AS median_b
        FROM (SELECT v, a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk,
                     count(*) FILTER (WHERE a) OVER () AS n1, count(*) FILTER (WHERE NOT a) OVER () AS n2
              FROM (SELECT anomaly_pct AS v, method_type = 'IsolationForest' AS a FROM results
                    WHERE method_type IN ('IsolationForest', 'DBSCAN'))),
             (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (
                SELECT count(*) AS c FROM results WHERE method_type IN ('IsolationForest', 'DBSCAN')
                GROUP BY anomaly_pct))
        GROUP BY n1, n2, ties)"""
SQL["mann_whitney"] = f"SELECT {_round('u', 'z', 'median_a', 'median_b')}, n_a, n_b, p_value FROM (" + _tail(
    "u, z, n_a, n_b, median_a, median_b", _MW, "least(z, 40)", _N_DENSITY, 2
) + ")"
SQL["mann_whitney_iforest"] = SQL["mann_whitney"]
SQL["normality_jb"] = """SELECT n, round(s, 6) AS skewness, round(k, 6) AS excess_kurtosis,
    round(n / 6.0 * (s * s + k * k / 4), 6) AS jb, round(exp(-(n / 6.0 * (s * s + k * k / 4)) / 2), 6) AS p_value
  FROM (SELECT count(*) AS n, avg(pow(d, 3)) / pow(avg(d * d), 1.5) AS s, avg(pow(d, 4)) / pow(avg(d * d), 2) - 3 AS k
        FROM (SELECT daily_revenue - (SELECT avg(daily_revenue) FROM daily) AS d FROM daily))"""
_NO = "CAST(NULL AS DOUBLE)"
SQL["claims_table"] = f"""
  SELECT 'success_rate' AS claim, method_type AS subject, n, estimate, ci_lower, ci_upper, {_NO} AS t, {_NO} AS p_value
  FROM ({SQL["bootstrap_ci"]})
  UNION ALL SELECT 'multi_feature_improvement', 'matched configurations', n_pairs, improvement_pct, {_NO}, {_NO}, t, p_value
  FROM ({SQL["paired_ttest"]})
  UNION ALL SELECT 'dbscan_below_half', 'DBSCAN', n, mean, {_NO}, {_NO}, t, p_value FROM ({SQL["one_sample_ttest"]})"""

# --- business queries ---
_MONTH = "strftime(order_date, '%Y-%m')"
_MONTHLY = f"SELECT {_MONTH} AS month, sum(value_c) AS c, count(*) AS n FROM fact WHERE {BILLABLE} GROUP BY 1"
_LAG = "lag(c) OVER (ORDER BY month)"
SQL["monthly_growth"] = f"""SELECT month, {cents("c")} AS revenue, n AS total_orders, {_avg_cents("c", "n")} AS avg_order_value,
  {ratio("(c - p)", "p", 1, 100)} AS mom_growth_pct FROM (SELECT *, {_LAG} AS p FROM ({_MONTHLY}))"""
SQL["monthly_growth_prev"] = f"""SELECT month, {cents("c")} AS revenue, n AS orders, {cents("p")} AS prev_month_revenue,
  {ratio("(c - p)", "p", 1, 100)} AS mom_growth_pct FROM (SELECT *, {_LAG} AS p FROM ({_MONTHLY}))"""
SQL["pareto_quintiles"] = f"""SELECT quintile, count(*) AS customers, {cents("sum(c)", 0)} AS segment_revenue,
  {ratio("sum(c)", "any_value(t)", 1, 100)} AS pct_of_total
  FROM (SELECT ntile(5) OVER (ORDER BY c DESC, customer_id) AS quintile, c, sum(c) OVER () AS t
        FROM (SELECT customer_id, sum(value_c) AS c FROM fact WHERE order_status = 'delivered' GROUP BY 1))
  GROUP BY quintile"""
_TYPE = "CASE WHEN z_score > 2.5 THEN '{}' WHEN z_score < -2.5 THEN '{}' ELSE '{}' END"
SQL["zscore_alerts"] = f"""SELECT {day()} AS order_date, daily_revenue, order_count, z_score,
  {_TYPE.format("SPIKE", "DROP", "NORMAL")} AS anomaly_type FROM daily WHERE abs(z_score) > 2.5"""
_W7 = "(ORDER BY order_date ROWS 6 PRECEDING)"
SQL["rolling_deviation"] = f"""SELECT {day("d")} AS order_date, daily_revenue, rolling_7d_avg, deviation_from_avg FROM (
  SELECT order_date AS d, daily_revenue, {_avg_cents("s", "n")} AS rolling_7d_avg,
         {_avg_cents("(rev_c * n - s)", "n")} AS deviation_from_avg
  FROM (SELECT *, sum(rev_c) OVER {_W7} AS s, count(*) OVER {_W7} AS n FROM daily))
  ORDER BY abs(deviation_from_avg) DESC, d LIMIT 15"""
SQL["anomaly_context"] = f"""SELECT {day()} AS order_date, daily_revenue, r AS rolling_7d_avg, prev_day_rev, next_day_rev,
  {cents("delta", 0)} AS day_over_day_change, CASE WHEN daily_revenue > r * 1.5 THEN '🔴 Spike'
    WHEN daily_revenue < r * 0.5 THEN '🔵 Drop' ELSE '✅ Normal' END AS pattern
  FROM (SELECT *, {_avg_cents("s", "n", 0)} AS r FROM (
    SELECT *, sum(rev_c) OVER {_W7} AS s, count(*) OVER {_W7} AS n,
           lag(daily_revenue) OVER (ORDER BY order_date) AS prev_day_rev,
           lead(daily_revenue) OVER (ORDER BY order_date) AS next_day_rev,
           rev_c - lag(rev_c) OVER (ORDER BY order_date) AS delta FROM daily)) WHERE anomaly_flag = 1"""
SQL["state_segments"] = f"""SELECT c.state, count(DISTINCT f.customer_id) AS unique_customers, count(*) AS total_orders,
  {ratio("sum(f.value_c)", "count(*)", 2, 1, 100)} AS avg_order_value, {cents("sum(f.value_c)", 0)} AS total_revenue,
  {ratio("count(*)", "count(DISTINCT f.customer_id)", 1)} AS orders_per_customer
  FROM fact f JOIN customers c ON f.customer_id = c.customer_id WHERE f.order_status = 'delivered' GROUP BY c.state"""
SQL["dow_orders"] = f"""SELECT CAST(dayofweek(order_date) AS INTEGER) AS dow, dayname(order_date) AS day_of_week,
  count(*) AS orders, {cents("sum(value_c)", 0)} AS total_revenue, {MEAN_VALUE} AS avg_value
  FROM fact WHERE {BILLABLE} GROUP BY 1, 2"""
SQL["cancel_rate"] = f"""SELECT category, count(*) AS total_orders,
  count(*) FILTER (WHERE order_status = 'cancelled') AS cancelled, {share("order_status = 'cancelled'")} AS cancel_rate_pct
  FROM by_category GROUP BY category HAVING count(*) > 10"""
SQL["freight_by_weight"] = f"""SELECT weight_category, count(*) AS orders,
  {ratio("sum(freight_c)", "count(*)", 2, 1, 100)} AS avg_freight, {MEAN_VALUE} AS avg_order_value,
  {ratio("sum(freight_c)", "sum(value_c)", 1, 100)} AS freight_pct_of_order
  FROM by_weight WHERE order_status = 'delivered' GROUP BY weight_category"""
_CATEGORY = f"""SELECT category, count(*) AS order_count, {cents("sum(value_c)", 0)} AS total_revenue,
  {MEAN_VALUE_0} AS avg_order_value FROM by_category WHERE {BILLABLE} GROUP BY category"""
SQL["category_revenue"] = f"SELECT category, total_revenue AS revenue FROM ({_CATEGORY})"
SQL["ask_category"] = f"""SELECT category, order_count AS total_orders, total_revenue AS revenue,
  avg_order_value AS avg_order FROM ({_CATEGORY})"""
SQL["category_pareto"] = f"""SELECT *, round(sum(total_revenue) OVER (ORDER BY total_revenue DESC, category
  ROWS UNBOUNDED PRECEDING) / sum(total_revenue) OVER () * 100, 4) AS cumulative_pct FROM ({_CATEGORY})"""
SQL["category_head"] = f"SELECT * FROM ({SQL['category_pareto']}) WHERE cumulative_pct <= 80"
SQL["category_tree"] = f"""SELECT category, {cents("sum(revenue_c)")} AS total_revenue, count(*) AS num_products,
  {ratio("sum(CAST(round(p * 100) AS BIGINT))", "count(*)", 4, 1, 100)} AS avg_price FROM (SELECT *, {_avg_cents("revenue_c", "qty")} AS p FROM sold WHERE category IS NOT NULL)
  GROUP BY category ORDER BY total_revenue DESC, category LIMIT 15"""
SQL["state_revenue"] = f"""SELECT customer_state, {cents("c")} AS total_revenue, n AS total_orders,
  {_avg_cents("c", "n")} AS avg_order_value, {ratio("c", "t", 1, 100)} AS revenue_pct
  FROM (SELECT *, sum(c) OVER () AS t FROM (SELECT state AS customer_state, sum(value_c) AS c, count(*) AS n FROM fact
        WHERE state IS NOT NULL GROUP BY 1)) ORDER BY total_revenue DESC, customer_state LIMIT 15"""
_STATE = f"""SELECT c.state, count(*) AS orders, {cents("sum(f.value_c)", 0)} AS revenue,
  {ratio("sum(f.value_c)", "count(*)", 0, 1, 100)} AS avg_order
  FROM fact f JOIN customers c ON f.customer_id = c.customer_id WHERE f.{BILLABLE} GROUP BY c.state"""
SQL["top_states"] = f"SELECT state, revenue FROM ({_STATE}) ORDER BY revenue DESC, state LIMIT 8"
SQL["ask_state"] = f"SELECT * FROM ({_STATE}) ORDER BY revenue DESC, state LIMIT 10"
SQL["pareto_curve"] = f"""SELECT customer_id, {cents("spent_c")} AS total_spent, rank, {cents("running_c")} AS cumulative_revenue,
  {ratio("running_c", "all_c", 4, 100)} AS cumulative_pct, {ratio("rank", "n", 4, 100)} AS customer_pct FROM customer_order"""
SQL["top20_share"] = f"""SELECT count(*) AS customers, {ratio("max(running_c)", "max(all_c)", 1, 100)} AS revenue_pct
  FROM customer_order WHERE rank * 100 <= n * 20"""
SQL["customer_split"] = f"""SELECT CASE WHEN rank <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'Top 20% Customers'
  ELSE 'Bottom 80% Customers' END AS segment, count(*) AS customers, {cents("sum(spent_c)")} AS revenue
  FROM customer_order GROUP BY 1"""
_MOY = f"""SELECT strftime(order_date, '%m') AS month_num, count(*) AS order_count, {cents("sum(value_c)", 0)} AS revenue,
  {MEAN_VALUE_0} AS avg_order_value FROM fact WHERE {BILLABLE} GROUP BY 1"""
SQL["month_of_year"] = _MOY
SQL["seasonal_month_check"] = f"""SELECT '08' AS month_num, max(order_count) FILTER (WHERE month_num = '08') AS order_count,
  max(revenue) FILTER (WHERE month_num = '08') AS revenue, round(avg(order_count), 4) AS avg_orders,
  round(avg(revenue), 4) AS avg_revenue,
  round((max(order_count) FILTER (WHERE month_num = '08') / avg(order_count) - 1) * 100, 4) AS order_deviation_pct,
  round((max(revenue) FILTER (WHERE month_num = '08') / avg(revenue) - 1) * 100, 4) AS revenue_deviation_pct
  FROM ({_MOY})"""
SQL["monthly_kpis"] = f"""SELECT {_MONTH} AS month, {cents("sum(rev_c)")} AS total_revenue,
  CAST(sum(order_count) AS BIGINT) AS total_orders FROM daily GROUP BY 1"""
SQL["dow_revenue_stats"] = f"""SELECT dayname(order_date) AS dow, CAST(isodow(order_date) - 1 AS INTEGER) AS dow_num,
  {ratio("sum(rev_c)", "count(*)", 4, 1, 100)} AS mean, round(stddev_samp(daily_revenue), 4) AS std,
  round(median(daily_revenue), 4) AS median FROM daily GROUP BY 1, 2"""


def _ma(rows: int) -> str:
    w = f"(ORDER BY order_date ROWS {rows - 1} PRECEDING)"
    return ratio(f"sum(rev_c) OVER {w}", f"count(*) OVER {w}", 4, 1, 100)


SQL["revenue_ma"] = f"""SELECT {day()} AS order_date, daily_revenue, {_ma(7)} AS revenue_ma7, {_ma(30)} AS revenue_ma30,
  is_true_anomaly, event_label FROM labelled"""
SQL["gt_listing"] = f"""SELECT {day()} AS order_date, CASE WHEN z_score > 0 THEN '📈 SPIKE' ELSE '📉 DROP' END AS direction,
  z_score, daily_revenue, event_label, count(*) OVER () AS total_events,
  count(*) FILTER (WHERE z_score > 0) OVER () AS spikes, count(*) FILTER (WHERE z_score < 0) OVER () AS drops
  FROM labelled WHERE is_true_anomaly = 1"""
SQL["order_value_hist"] = f"""SELECT bin, {ratio("(low * 40 + bin * (high - low))", "40", 4, 1, 100)} AS bin_start,
  {ratio("(low * 40 + (bin + 1) * (high - low))", "40", 4, 1, 100)} AS bin_end, count(*) AS orders
  FROM (SELECT low, high, coalesce(least((value_c - low) * 40 // nullif(high - low, 0), 39), 0) AS bin
        FROM fact, (SELECT min(value_c) AS low, max(value_c) AS high FROM fact)) GROUP BY bin, low, high"""
_V = "CAST(value_c AS DOUBLE) / 100"
SQL["order_value_box"] = f"""SELECT count(*) AS orders, min({_V}) AS low, round(any_value(q[1]), 4) AS q1,
  round(any_value(q[2]), 4) AS median, round(any_value(q[3]), 4) AS q3, max({_V}) AS high,
  count(*) FILTER (WHERE {_V} < q[1] - (q[3] - q[1]) * 1.5 OR {_V} > q[3] + (q[3] - q[1]) * 1.5) AS outliers
  FROM fact, (SELECT quantile_cont({_V}, [0.25, 0.5, 0.75]) AS q FROM fact)"""
SQL["kpi_cards"] = f"""SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fact
  UNION ALL SELECT 'revenue', {cents("sum(value_c)", 0)} FROM fact WHERE {BILLABLE}
  UNION ALL SELECT 'anomaly_days', CAST(count(*) AS DOUBLE) FROM daily WHERE anomaly_flag = 1
  UNION ALL SELECT 'days', CAST(count(*) AS DOUBLE) FROM daily"""
SQL["daily_split"] = f"""SELECT {day()} AS order_date, CASE WHEN anomaly_flag = 0 THEN daily_revenue END AS normal_revenue,
  CASE WHEN anomaly_flag = 1 THEN daily_revenue END AS anomaly_revenue FROM daily"""
SQL["report_monthly_avg"] = f"""SELECT CAST(month(order_date) AS INTEGER) AS month_num, strftime(order_date, '%b') AS month,
  {_avg_cents("sum(rev_c)", "count(*)")} AS avg_revenue FROM daily GROUP BY 1, 2"""
SQL["report_kpis"] = f"""SELECT (SELECT {cents("sum(value_c)")} FROM fact) AS total_revenue,
  (SELECT count(*) FROM ({SQL["sigma_band"]})) AS anomaly_days, method_type AS best_method, rate AS best_rate
  FROM (SELECT method_type, {share(band())} AS rate FROM results GROUP BY method_type)
  ORDER BY rate DESC, method_type LIMIT 1"""

# --- questions ---
_REV0 = f"{cents('rev_c', 0)} AS revenue"
SQL["ask_anomalies"] = f"""SELECT {day("d")} AS order_date, revenue, order_count, z_score, '🚨 Anomaly' AS status FROM (
  SELECT order_date AS d, {_REV0}, order_count, z_score FROM daily WHERE anomaly_flag = 1
  ORDER BY abs(z_score) DESC, order_date LIMIT 10)"""
SQL["ask_zscore"] = f"""SELECT {day("d")} AS order_date, revenue, z_score,
  {_TYPE.format("📈 High Spike", "📉 Big Drop", "✅ Normal")} AS status FROM (
  SELECT order_date AS d, {_REV0}, z_score FROM daily WHERE abs(z_score) > 2 ORDER BY abs(z_score) DESC, order_date LIMIT 10)"""
for _name, _dir in (("ask_top_days", "DESC"), ("ask_worst_days", "ASC")):
    SQL[_name] = f"""SELECT {day("d")} AS order_date, revenue, order_count FROM (
      SELECT order_date AS d, {_REV0}, order_count FROM daily ORDER BY daily_revenue {_dir}, order_date LIMIT 10)"""
SQL["ask_monthly"] = f"""SELECT {_MONTH} AS month, {cents("sum(value_c)", 0)} AS revenue, count(*) AS orders,
  {MEAN_VALUE_0} AS avg_order FROM fact WHERE {BILLABLE} GROUP BY 1"""
SQL["ask_status"] = f"""SELECT order_status, count(*) AS orders, {cents("sum(value_c)", 0)} AS revenue,
  {ratio("count(*)", "any_value(t)", 1, 100)} AS pct_of_total
  FROM fact_all, (SELECT count(*) AS t FROM fact_all) GROUP BY order_status"""
_WHOLE = f"CAST(CAST({cents('sum(value_c)', 0)} AS BIGINT) AS VARCHAR)"
SQL["ask_overview"] = f"""SELECT 'Total Orders' AS metric, CAST(count(*) AS VARCHAR) AS value FROM fact
  UNION ALL SELECT 'Total Revenue', {_WHOLE} FROM fact WHERE {BILLABLE}
  UNION ALL SELECT 'Anomaly Days Detected', CAST(sum(anomaly_flag) AS VARCHAR) FROM daily
  UNION ALL SELECT 'Total Days Monitored', CAST(count(*) AS VARCHAR) FROM daily
  UNION ALL SELECT 'Models Tested', CAST(count(*) AS VARCHAR) FROM results"""


def _rule(groups) -> str:
    return " AND ".join("(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")" for words in groups)


_WHENS = " ".join(f"WHEN {_rule(groups)} THEN '{name}'" for name, groups in RULES)
SQL["question_intents"] = rf"""SELECT CASE WHEN q IS NULL OR regexp_full_match(q, '\s*') THEN 'empty' {_WHENS} ELSE 'overview'
  END AS intent, count(*) AS questions FROM (SELECT lower(text) AS q FROM conversations WHERE role = 'user') GROUP BY 1"""

# --- quality ---
_FACT_NAMES = {
    "order_id": "order_id", "customer_id": "customer_id", "order_date": "order_date", "order_status": "order_status",
    "order_value": "value_c", "freight_value": "freight_c", "items_count": "items_count",
    "unique_products": "unique_products", "customer_city": "city", "customer_state": "state",
}
_EPOCH = "date_diff('day', DATE '1970-01-01', {}(order_date))"
SQL["dq_report"] = "SELECT 'rows' AS \"check\", count(*) AS value FROM fact_all" + "".join(
    f" UNION ALL SELECT 'nulls_{n}', count(*) FILTER (WHERE {c} IS NULL) FROM fact_all" for n, c in _FACT_NAMES.items()
) + f"""
  UNION ALL SELECT 'non_positive_order_value', count(*) FILTER (WHERE value_c <= 0) FROM fact_all
  UNION ALL SELECT 'first_day', {_EPOCH.format("min")} FROM fact_all
  UNION ALL SELECT 'last_day', {_EPOCH.format("max")} FROM fact_all
  UNION ALL SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fact_all)) FROM fact_all
  UNION ALL SELECT 'orphan_customers', count(*) FROM ({SQL["orphan_customers"]})
  UNION ALL SELECT 'rows_above_p99', count(*) FROM fact_all WHERE CAST(value_c AS DOUBLE) / 100 >
    (SELECT quantile_cont(CAST(value_c AS DOUBLE) / 100, 0.99) FROM fact_all)"""
SQL["dq_rules"] = """SELECT 'negative_order_value' AS "check", count(*) FILTER (WHERE value_c < 0) AS violations FROM fact
  UNION ALL SELECT 'duplicate_order_id', count(*) - count(DISTINCT order_id) FROM fact
  UNION ALL SELECT 'rows_missing_fact_orders', greatest(90000 - count(*), 0) FROM fact
  UNION ALL SELECT 'rows_missing_dim_customers', greatest(1 - count(*), 0) FROM customers
  UNION ALL SELECT 'rows_missing_dim_products', greatest(1 - count(*), 0) FROM sold
  UNION ALL SELECT 'rows_missing_daily_kpis', greatest(1 - count(*), 0) FROM daily
  UNION ALL SELECT 'rows_missing_model_results', greatest(1 - count(*), 0) FROM results"""

# --- events ---
_VALUE_C = "CAST(round(value * 100) AS BIGINT)"
_EVENT_DAY = f"""{cents(f"sum({_VALUE_C})")} AS daily_value, count(*) AS event_count,
  {ratio(f"sum({_VALUE_C})", "count(*)", 2, 1, 100)} AS avg_value"""
SQL["events_daily_kpis"] = f"""SELECT event_type, {day("CAST(ts AS DATE)")} AS order_date, {_EVENT_DAY},
  count(DISTINCT user_id) AS unique_users FROM events GROUP BY event_type, CAST(ts AS DATE)"""
SQL["stream_daily_kpis"] = f"""SELECT event_type, {day("CAST(ts AS DATE)")} AS order_date, {_EVENT_DAY} FROM events
  GROUP BY event_type, CAST(ts AS DATE)"""
SQL["events_alerts"] = f"""SELECT event_id, event_type, {day("CAST(ts AS DATE)")} AS order_date, value, z AS z_score,
  CASE WHEN z > 2.5 THEN 'SPIKE' ELSE 'DROP' END AS alert
  FROM (SELECT *, round((value - avg(value) OVER (PARTITION BY event_type))
                        / nullif(stddev_samp(value) OVER (PARTITION BY event_type), 0), 6) AS z FROM events)
  WHERE abs(z) > 2.5 AND strftime(ts, '%m-%d') NOT IN ('01-01', '12-25')
    AND NOT (month(ts) = 5 AND isodow(ts) = 7 AND day(ts) BETWEEN 8 AND 14)
    AND NOT (month(ts - INTERVAL 1 DAY) = 11 AND isodow(ts - INTERVAL 1 DAY) = 4 AND day(ts - INTERVAL 1 DAY) BETWEEN 22 AND 28)"""
SQL["stream_alerts"] = SQL["events_alerts"]
SQL["stream_ewm"] = f"""
  WITH d AS (SELECT event_type, CAST(ts AS DATE) AS order_date, {cents(f"sum({_VALUE_C})")} AS x FROM events GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY order_date) AS i,
               x - first_value(x) OVER (PARTITION BY event_type ORDER BY order_date) AS y FROM d),
  s AS (SELECT a.event_type, a.i, sum(w) AS w, sum(w * w) AS w2, sum(w * b.y) / sum(w) AS m, sum(w * b.y * b.y) / sum(w) AS m2
        FROM r a JOIN (SELECT event_type, i AS j, y FROM r) b ON a.event_type = b.event_type AND b.j <= a.i,
             LATERAL (SELECT pow(0.75, a.i - b.j) AS w) GROUP BY 1, 2)
  SELECT event_type, {day()} AS order_date, round(coalesce(abs((y - m) / nullif(coalesce(
    sqrt(greatest(m2 - m * m, 0) * w * w / nullif(w * w - w2, 0)), 1), 0)), 0), 4) AS score
  FROM s JOIN r USING (event_type, i)"""

SQL["stream_ewm_ordered"] = SQL["stream_ewm"]

# --- baselines with a validity ---
_SPREAD = "sqrt(CAST(n * q - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1))) / 100"
_VERSIONS = f"""
  SELECT valid_from, coalesce(next, valid_from + INTERVAL 90 DAY)::DATE AS valid_to, n AS base_rows,
         CAST(s AS DOUBLE) / (CAST(n AS DOUBLE) * 100) AS base_mean, {_SPREAD} AS base_std
  FROM (SELECT CAST(m AS DATE) AS valid_from, CAST(lead(m) OVER (ORDER BY m) AS DATE) AS next FROM (
          SELECT unnest(generate_series(date_trunc('month', min(order_date)), max(order_date) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m
          FROM daily)),
       LATERAL (SELECT count(*) AS n, sum(CAST(rev_c AS HUGEINT)) AS s, sum(CAST(rev_c AS HUGEINT) * rev_c) AS q FROM daily
                WHERE order_date >= valid_from - INTERVAL 90 DAY AND order_date < valid_from)
  WHERE n >= 2"""
SQL["baseline_versions"] = f"""SELECT {day("valid_from")} AS valid_from, {day("valid_to")} AS valid_to, base_rows,
  round(base_mean, 4) AS base_mean, round(base_std, 4) AS base_std FROM ({_VERSIONS})"""
_ALERT = "CASE WHEN z_score > 0 THEN 'SPIKE' ELSE 'DROP' END AS alert"
SQL["asof_alerts"] = f"""SELECT {day()} AS order_date, daily_revenue, {day("valid_from")} AS valid_from, z_score, {_ALERT}
  FROM (SELECT order_date, daily_revenue, valid_from, round((daily_revenue - base_mean) / nullif(base_std, 0), 6) AS z_score
        FROM daily JOIN ({_VERSIONS}) ON order_date >= valid_from AND order_date < valid_to)
  WHERE abs(z_score) > 2 AND order_date NOT IN (SELECT event_date FROM calendar)"""
SQL["events_asof_alerts"] = f"""
  WITH e AS (SELECT *, CAST(ts AS DATE) AS d, {_VALUE_C} AS c FROM events),
  days AS (SELECT event_type, d, count(*) AS n, sum(c) AS s, sum(CAST(c AS HUGEINT) * c) AS q FROM e GROUP BY ALL),
  v AS (SELECT a.event_type, a.d AS valid_from, sum(b.n) AS n, CAST(sum(b.s) AS HUGEINT) AS s, CAST(sum(b.q) AS HUGEINT) AS q
        FROM days a JOIN days b ON a.event_type = b.event_type AND b.d < a.d AND b.d >= a.d - INTERVAL 90 DAY GROUP BY 1, 2),
  z AS (SELECT e.*, valid_from,
               round((value - CAST(s AS DOUBLE) / (CAST(n AS DOUBLE) * 100)) / nullif({_SPREAD}, 0), 6) AS z_score
        FROM e JOIN v ON e.event_type = v.event_type AND e.d = v.valid_from WHERE n >= 2)
  SELECT event_id, event_type, {day("d")} AS order_date, value, {day("valid_from")} AS valid_from, z_score, {_ALERT}
  FROM z WHERE abs(z_score) > 2.5 AND strftime(ts, '%m-%d') NOT IN ('01-01', '12-25')
    AND NOT (month(ts) = 5 AND isodow(ts) = 7 AND day(ts) BETWEEN 8 AND 14)
    AND NOT (month(ts - INTERVAL 1 DAY) = 11 AND isodow(ts - INTERVAL 1 DAY) = 4 AND day(ts - INTERVAL 1 DAY) BETWEEN 22 AND 28)"""
SQL["stream_asof_alerts"] = SQL["events_asof_alerts"]

# --- mergeable sketches: their bounds must hold ---
_PERIODS = """SELECT strftime(order_date, '%Y-%m') AS period, value_c / 100.0 AS v FROM fact
  UNION ALL SELECT 'all', value_c / 100.0 FROM fact"""
SQL["quantile_sketches"] = f"""
  SELECT period, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS rank, n, round(unnest(q), 4) AS exact, true AS within_bound
  FROM (SELECT period, count(*) AS n, quantile_cont(CAST(v AS DOUBLE), [0.25, 0.5, 0.95]) AS q FROM ({_PERIODS}) GROUP BY period)"""
SQL["distinct_customers"] = """
  SELECT grain, period, count(DISTINCT customer_id) AS customers, true AS within_bound FROM (
    SELECT 'week' AS grain, strftime(date_trunc('week', order_date), '%Y-%m-%d') AS period, customer_id FROM fact
    UNION ALL SELECT 'month', strftime(order_date, '%Y-%m'), customer_id FROM fact
    UNION ALL SELECT 'all', 'all', customer_id FROM fact) GROUP BY grain, period"""
SQL["stream_distinct_users"] = """
  SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(DISTINCT user_id) AS users, true AS within_bound
  FROM events GROUP BY ALL"""

_BYTES = " + ".join(f"CAST('0x' || substr(h, {k}, 8) AS BIGINT)" for k in (1, 9, 17, 25))
SQL["little_bootstraps"] = f"""SELECT * FROM (
  WITH sized AS (SELECT *, CAST(value_c / 100.0 AS DOUBLE) AS x, count(*) OVER (PARTITION BY state) AS n FROM fact WHERE state IS NOT NULL),
  parted AS (SELECT state, order_id, x, n,
                    ({_HEX.format("concat_ws('-', 42, order_id)")} * CAST(floor(n / ceil(pow(n, 0.6))) AS BIGINT)) >> 32 AS part
             FROM sized WHERE n >= 10),
  drawn AS (SELECT *, n / CAST(count(*) OVER (PARTITION BY state, part) AS DOUBLE) AS rate FROM parted WHERE part < 10),
  hashed AS (SELECT *, md5(concat_ws('-', 42, b, order_id)) AS h FROM drawn, range(81) t(b)),
  weighted AS (
    SELECT state, part, b, x,
           CAST(greatest(floor(rate + sqrt(rate) * ((({_BYTES}) - 8589934590) / 4294967296.0::DOUBLE * sqrt(3.0::DOUBLE)) + 0.5), 0) AS BIGINT) AS w
    FROM hashed),
  running AS (SELECT *, sum(w) OVER (PARTITION BY state, part, b ORDER BY x, w) AS upto,
                     sum(w) OVER (PARTITION BY state, part, b) AS total FROM weighted),
  stats AS (
    SELECT state, part, b, sum(x * w) / CAST(sum(w) AS DOUBLE) AS mean,
           (min(x) FILTER (WHERE upto > (total - 1) // 2) + min(x) FILTER (WHERE upto > total // 2)) / 2 AS median
    FROM running WHERE w > 0 GROUP BY state, part, b),
  long AS (UNPIVOT stats ON mean, median INTO NAME statistic VALUE stat),
  cis AS (SELECT state, part, statistic, quantile_cont(stat, [0.025, 0.975]) AS ci FROM long GROUP BY ALL),
  points AS (SELECT state, count(*) AS n, avg(x) AS mean, median(x) AS median FROM sized GROUP BY state)
  SELECT c.state AS customer_state, c.statistic, p.n, round(CASE c.statistic WHEN 'mean' THEN p.mean ELSE p.median END, 4) AS estimate,
         round(avg(ci[1]), 4) AS ci_lower, round(avg(ci[2]), 4) AS ci_upper
  FROM cis c JOIN points p USING (state) GROUP BY c.state, c.statistic, p.n, p.mean, p.median)"""

# --- order CSVs and re-runs ---
SQL["csv_star"] = SQL["fact_orders"]
SQL["csv_rejects"] = """
  SELECT 'orders' AS table_name, unnest(['does not parse', 'no order_id']) AS reason, count(*) AS rows FROM all_orders WHERE order_id % 400 = 0
  HAVING count(*) > 0
  UNION ALL SELECT 'items', unnest(['does not parse', 'negative price', 'no product_id']), count(*) FROM items WHERE order_id % 400 = 0
  HAVING count(*) > 0"""
SQL["changed_months"] = f"""
  SELECT month, orders, CASE WHEN rewritten THEN {cents("later_c")} ELSE {cents("value_c")} END AS revenue, rewritten
  FROM (SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders, sum(value_c) AS value_c, sum(value_c + 1) AS later_c,
               strftime(order_date, '%Y-%m') = (SELECT max(strftime(order_date, '%Y-%m')) FROM fact) AS rewritten FROM fact GROUP BY 1)"""
SQL["table_listing"] = """
  SELECT 'fact_orders' AS table_name, 11 AS columns, count(DISTINCT strftime(order_date, '%Y-%m')) AS partitions FROM fact
  UNION ALL SELECT 'daily_kpis', 10, 0 FROM daily HAVING count(*) > 0 UNION ALL SELECT 'dim_products', 7, 0 FROM sold HAVING count(*) > 0"""

SQL["rca_report"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM ({SQL[t]})"
    for t in ("rca_method", "rca_feature_set", "rca_scaler", "rca_dbscan", "rca_param_failure", "rca_best",
              "rca_contamination")
)

ORACLE = {name: query(body) for name, body in SQL.items()}
