"""Shared common table expressions. Money is kept in integer cents, so ratios round half up exactly."""

from __future__ import annotations

import re
import zlib

from revwatch.oracle.constants import (
    DBSCAN_EPS,
    DBSCAN_MIN_SAMPLES,
    FEATURE_SETS,
    FOREST_CONTAMINATION,
    FOREST_SHARES,
    FOREST_SIZES,
    IQR_MULTIPLIERS,
    LOF_CONTAMINATION,
    LOF_NEIGHBORS,
    MAD_SCALE,
    MAD_THRESHOLDS,
    NAMES,
    SEASON_PERIODS,
    SERIES_FEATURES,
    SERIES_THRESHOLDS,
    SERIES_WINDOWS,
    ZSCORE_FEATURES,
    ZSCORE_THRESHOLDS,
    ewm_rows,
)


def ratio(num: str, den: str, scale: int, factor: int = 1, unit: int = 1) -> str:
    """round(factor * num / (unit * den), scale) of integers, half away from zero; NULL when ``den`` is 0."""
    top, bottom = f"CAST({num} AS HUGEINT)", f"(CAST({den} AS HUGEINT) * {unit})"
    scaled = f"(2 * abs({top}) * {factor * 10**scale} + abs({bottom})) // (2 * abs({bottom}))"
    sign = f"(CASE WHEN sign({top}) * sign({bottom}) < 0 THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {den} = 0 THEN NULL ELSE CAST({sign} * ({scaled}) AS DOUBLE) / {10**scale} END)"


def cents(expr: str, scale: int = 2) -> str:
    """Cents as money rounded to ``scale`` digits."""
    return ratio(expr, "1", scale, 1, 100)


def day(expr: str = "order_date") -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def band(expr: str = "anomaly_pct") -> str:
    return f"{expr} BETWEEN 3 AND 10"


def share(condition: str, scale: int = 1) -> str:
    return ratio(f"count(*) FILTER (WHERE {condition})", "count(*)", scale, 100)


MEAN_PCT_TENTHS = "CAST(sum(CAST(round(anomaly_pct * 10) AS BIGINT)) AS HUGEINT)"


def mean_pct(scale: int = 2) -> str:
    return ratio(MEAN_PCT_TENTHS, "count(*)", scale, 1, 10)


CTES: dict[str, str] = {}

CTES["items"] = """
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
         (CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50) // 100 AS freight_c
  FROM lineitem"""
CTES["totals"] = """
  SELECT order_id, CAST(sum(price_c) AS BIGINT) AS value_c, CAST(sum(freight_c) AS BIGINT) AS freight_c,
         count(*) AS items_count, count(DISTINCT product_id) AS unique_products
  FROM items GROUP BY order_id"""
CTES["all_orders"] = """
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'cancelled' END
           AS order_status
  FROM orders"""
CTES["fact_all"] = """
  SELECT o.order_id, c.c_custkey AS customer_id, o.order_date, o.order_status, t.value_c, t.freight_c,
         t.items_count, t.unique_products, c.c_mktsegment AS city, n.n_name AS state
  FROM all_orders o JOIN totals t USING (order_id)
  LEFT JOIN customer c ON o.customer_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""
CTES["fact"] = """
  SELECT * FROM fact_all WHERE order_status IN ('delivered', 'shipped', 'invoiced', 'processing')"""
CTES["products"] = """
  SELECT p_partkey AS product_id, p_type AS category, CAST(p_size * 200 AS DOUBLE) AS weight_g FROM part"""
CTES["spend"] = """
  SELECT customer_id, arg_min(city, (order_date, order_id)) AS city, arg_min(state, (order_date, order_id)) AS state,
         count(*) AS total_orders, CAST(sum(value_c) AS BIGINT) AS spent_c,
         min(order_date) AS first_purchase, max(order_date) AS last_purchase
  FROM fact GROUP BY customer_id"""
CTES["customers"] = """
  SELECT s.*, CASE WHEN spent_c <= 0 THEN 'nan' WHEN spent_c / 100.0 <= q75 THEN 'low_value'
                   WHEN spent_c / 100.0 <= q95 THEN 'medium' ELSE 'high_value' END AS tier
  FROM spend s, (SELECT quantile_cont(spent_c / 100.0, 0.75) AS q75, quantile_cont(spent_c / 100.0, 0.95) AS q95
                 FROM spend)"""
CTES["sold"] = """
  SELECT p.product_id, p.category, p.weight_g, s.qty, s.revenue_c, s.freight_c
  FROM products p JOIN (SELECT product_id, count(*) AS qty, CAST(sum(price_c) AS BIGINT) AS revenue_c,
                               CAST(sum(freight_c) AS BIGINT) AS freight_c
                        FROM items GROUP BY product_id) s USING (product_id)"""
CTES["customer_order"] = f"""
  SELECT *, row_number() OVER (ORDER BY spent_c DESC, customer_id) AS rank, count(*) OVER () AS n,
         sum(spent_c) OVER (ORDER BY spent_c DESC, customer_id ROWS UNBOUNDED PRECEDING) AS running_c,
         sum(spent_c) OVER () AS all_c
  FROM spend"""
CTES["by_category"] = """
  SELECT i.order_id, p.category, o.order_status, sum(i.price_c) AS value_c, sum(i.freight_c) AS freight_c
  FROM items i JOIN products p USING (product_id) JOIN all_orders o USING (order_id) GROUP BY ALL"""
CTES["by_weight"] = """
  SELECT i.order_id, CASE WHEN p.weight_g < 1000 THEN 'Light (<1kg)' WHEN p.weight_g < 5000 THEN 'Medium (1-5kg)'
                          ELSE 'Heavy (>5kg)' END AS weight_category,
         o.order_status, sum(i.price_c) AS value_c, sum(i.freight_c) AS freight_c
  FROM items i JOIN products p USING (product_id) JOIN all_orders o USING (order_id) GROUP BY ALL"""


def daily_sql(key: str = "") -> str:
    cols = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return f"""
  SELECT *, CAST(coalesce(abs(z_score) > 2.5, false) AS INTEGER) AS anomaly_flag FROM (
    SELECT *, round((daily_revenue - avg(daily_revenue) OVER ({part}))
                    / nullif(stddev_samp(daily_revenue) OVER ({part}), 0), 3) AS z_score
    FROM (SELECT {cols}order_date, CAST(sum(value_c) AS BIGINT) AS rev_c, {cents("sum(value_c)")} AS daily_revenue,
                 count(*) AS order_count, {ratio("sum(value_c)", "count(*)", 2, 1, 100)} AS avg_order_value,
                 {ratio("sum(freight_c)", "count(*)", 2, 1, 100)} AS avg_freight,
                 count(DISTINCT customer_id) AS unique_customers
          FROM fact GROUP BY {cols}order_date))"""


CTES["daily"] = daily_sql()
CTES["daily_state"] = daily_sql("state")
CTES["order_years"] = "\n  SELECT unnest(range(min(year(order_date)), max(year(order_date)) + 1)) AS y FROM all_orders"
CTES["order_year_days"] = """
  SELECT make_date(y, 1, 1) + CAST(i AS INTEGER) AS d
  FROM order_years, (SELECT unnest(range(366)) AS i) WHERE year(make_date(y, 1, 1) + CAST(i AS INTEGER)) = y"""
CTES["calendar"] = """
  SELECT * FROM (
    SELECT make_date(y, 1, 1) AS event_date, 'drop' AS type, 'high' AS severity, 'New Year''s Day ' || y AS label
    FROM order_years
    UNION ALL SELECT make_date(y, 12, 25), 'drop', 'high', 'Christmas Day ' || y FROM order_years
    UNION ALL SELECT d, 'spike', 'high', 'Mother''s Day ' || year(d) FROM order_year_days
      WHERE month(d) = 5 AND isodow(d) = 7 AND day(d) BETWEEN 8 AND 14
    UNION ALL SELECT d + 1, 'spike', 'high', 'Black Friday ' || year(d) FROM order_year_days
      WHERE month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28)"""
CTES["labelled"] = """
  SELECT d.*, CAST(c.label IS NOT NULL OR coalesce(abs(d.z_score) > 3.5, false) AS INTEGER) AS is_true_anomaly,
         coalesce(c.label, CASE WHEN abs(d.z_score) > 3.5 THEN 'Extreme statistical outlier' END, '') AS event_label,
         c.type, c.severity
  FROM daily d LEFT JOIN calendar c ON d.order_date = c.event_date"""


def _mean_over(col: str, rows: int, unit: str = "") -> str:
    w = f"(ORDER BY order_date ROWS {rows - 1} PRECEDING)"
    return f"CAST(sum({col}) OVER {w} AS DOUBLE){unit} / count(*) OVER {w}"


CTES["features"] = f"""
  SELECT order_date, is_true_anomaly, daily_revenue, CAST(order_count AS DOUBLE) AS order_count, avg_order_value,
         avg_freight, {_mean_over("rev_c", 7, " / 100")} AS revenue_ma7, {_mean_over("rev_c", 30, " / 100")} AS revenue_ma30,
         coalesce(stddev_samp(daily_revenue) OVER (ORDER BY order_date ROWS 6 PRECEDING), 0) AS revenue_std7,
         {_mean_over("order_count", 7)} AS orders_ma7,
         coalesce(CAST(rev_c - lag(rev_c) OVER (ORDER BY order_date) AS DOUBLE) / 100, 0) AS revenue_diff,
         coalesce(daily_revenue / nullif(lag(daily_revenue) OVER (ORDER BY order_date), 0) - 1, 0)
           AS revenue_pct_change,
         CAST(isodow(order_date) - 1 AS DOUBLE) AS day_of_week
  FROM labelled"""

USED = sorted({c for cols in FEATURE_SETS.values() for c in cols})
CTES["scaled"] = "\n  SELECT order_date, is_true_anomaly, " + ",\n         ".join(
    f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 9) AS {c}" for c in USED
) + "\n  FROM features"


def _long(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature_set, order_date, is_true_anomaly AS truth, {c} AS x FROM features" for c in columns
    )


CTES["long6"] = "\n  " + _long(ZSCORE_FEATURES)
CTES["long3"] = "\n  " + _long(SERIES_FEATURES)

_P = "PARTITION BY feature_set"
CTES["z_scores"] = f"""
  SELECT feature_set, order_date, truth,
         round(abs((x - avg(x) OVER ({_P})) / nullif(stddev_samp(x) OVER ({_P}), 0)), 9) AS score FROM long6"""


def _rolling(rows: int) -> str:
    w = f"({_P} ORDER BY order_date ROWS {rows - 1} PRECEDING)"
    return (
        f"SELECT feature_set, order_date, truth, {rows} AS win, round(coalesce(abs((x - avg(x) OVER {w}) / "
        f"nullif(coalesce(stddev_samp(x) OVER {w}, 1), 0)), 0), 9) AS score FROM long3"
    )


CTES["rolling_scores"] = "\n  " + "\n  UNION ALL ".join(_rolling(n) for n in SERIES_WINDOWS)
CTES["iqr_scores"] = f"""
  SELECT feature_set, order_date, truth, round(greatest(x - q3, q1 - x, 0) / nullif(q3 - q1, 0), 9) AS score
  FROM long6 JOIN (SELECT feature_set, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
                   FROM long6 GROUP BY 1) USING (feature_set)"""
CTES["mad_scores"] = f"""
  SELECT feature_set, order_date, truth, round(gap / nullif({MAD_SCALE} * median(gap) OVER ({_P}), 0), 9) AS score
  FROM (SELECT *, abs(x - median(x) OVER ({_P})) AS gap FROM long6)"""
CTES["ewm_spans"] = "\n  SELECT * FROM (VALUES " + ", ".join(
    f"({s}, {ewm_rows(s)})" for s in SERIES_WINDOWS
) + ") t(span, horizon)"
CTES["ewm_rows"] = """
  SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY order_date) AS i,
         x - first_value(x) OVER (PARTITION BY feature_set ORDER BY order_date) AS y FROM long3"""
CTES["ewm_sums"] = """
  SELECT feature_set, span, i, sum(w) AS w, sum(w * w) AS w2, sum(w * y) / sum(w) AS m, sum(w * y * y) / sum(w) AS m2
  FROM (SELECT a.feature_set, s.span, a.i, b.y, pow(1 - 2.0 / (s.span + 1), a.i - b.i) AS w
        FROM ewm_rows a JOIN ewm_spans s ON true
        JOIN ewm_rows b ON a.feature_set = b.feature_set AND b.i <= a.i AND b.i >= a.i - s.horizon)
  GROUP BY ALL"""
CTES["ewm_scores"] = """
  SELECT feature_set, order_date, truth, span,
         round(coalesce(abs((y - m) / nullif(coalesce(sqrt(greatest(m2 - m * m, 0) * w * w / nullif(w * w - w2, 0)), 1), 0)),
                        0), 9) AS score
  FROM ewm_sums JOIN ewm_rows USING (feature_set, i)"""


def _seasonal(period: int) -> str:
    half = period // 2
    w = f"({_P} ORDER BY order_date ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return (
        f"SELECT feature_set, order_date, truth, {period} AS period, "
        f"(row_number() OVER ({_P} ORDER BY order_date) - 1) % {period} AS phase, "
        f"round(x - avg(x) OVER {w}, 6) AS detrended FROM long3"
    )


CTES["seasonal_parts"] = "\n  " + "\n  UNION ALL ".join(_seasonal(p) for p in SEASON_PERIODS)
CTES["seasonal_resid"] = """
  SELECT *, detrended - median(detrended) OVER (PARTITION BY feature_set, period, phase) AS resid FROM seasonal_parts"""
CTES["seasonal_scores"] = """
  SELECT feature_set, order_date, truth, period,
         round(abs((resid - avg(resid) OVER (PARTITION BY feature_set, period))
                   / (stddev_pop(resid) OVER (PARTITION BY feature_set, period) + 1e-8)), 9) AS score
  FROM seasonal_resid"""


def _pairs(extra: str = "", join: str = "") -> str:
    parts = []
    for name, cols in FEATURE_SETS.items():
        square = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
        parts.append(
            f"SELECT '{name}' AS feature_set, a.order_date AS a, b.order_date AS b, round(sqrt({square}), 9) AS d "
            f"FROM scaled a, scaled b"
        )
    return "\n  " + "\n  UNION ALL ".join(parts)


CTES["point_pairs"] = _pairs()
CTES["truths"] = "\n  SELECT order_date AS a, is_true_anomaly AS truth FROM features"
EPS = DBSCAN_EPS
CTES["eps_counts"] = "\n  SELECT feature_set, a, " + ", ".join(
    f"count(*) FILTER (WHERE d <= {e}) AS c{i}" for i, e in enumerate(EPS)
) + " FROM point_pairs GROUP BY feature_set, a"
CTES["eps_best"] = "\n  SELECT p.feature_set, p.a, " + ", ".join(
    f"max(c{i}) FILTER (WHERE d <= {e}) AS m{i}" for i, e in enumerate(EPS)
) + """ FROM point_pairs p JOIN (SELECT feature_set AS fs, a AS q, * EXCLUDE (feature_set, a) FROM eps_counts) c
    ON p.feature_set = c.fs AND p.b = c.q GROUP BY p.feature_set, p.a"""
CTES["eps_density"] = "\n  " + "\n  UNION ALL ".join(
    f"SELECT feature_set, a, truth, CAST({e} AS DOUBLE) AS eps, m{i} AS density FROM eps_best JOIN truths USING (a)"
    for i, e in enumerate(EPS)
)
K_MAX = max(LOF_NEIGHBORS)
CTES["knn"] = f"""
  SELECT feature_set, a, unnest(list_sort(nn)) AS e, generate_subscripts(list_sort(nn), 1) AS pos
  FROM (SELECT feature_set, a, min({{'d': d, 'nb': b}}, {K_MAX}) AS nn FROM point_pairs WHERE a <> b
        GROUP BY feature_set, a)"""
CTES["ks"] = "\n  SELECT unnest([" + ", ".join(map(str, LOF_NEIGHBORS)) + "]) AS k"
CTES["k_dist"] = """
  SELECT feature_set, a, k, max(e.d) AS kd FROM knn JOIN ks ON pos <= k GROUP BY ALL"""
CTES["lrd"] = """
  SELECT n.feature_set, n.a, k.k, 1.0 / (avg(greatest(n.e.d, k.kd)) + 1e-10) AS density
  FROM knn n JOIN k_dist k ON k.feature_set = n.feature_set AND k.a = n.e.nb AND n.pos <= k.k GROUP BY ALL"""
CTES["lof"] = """
  SELECT n.feature_set, n.a, o.k, avg(o.density / p.density) AS score
  FROM knn n JOIN lrd o ON o.feature_set = n.feature_set AND o.a = n.e.nb AND n.pos <= o.k
  JOIN lrd p ON p.feature_set = n.feature_set AND p.a = n.a AND p.k = o.k GROUP BY ALL"""
CTES["lof_scores"] = "\n  SELECT feature_set, a AS order_date, truth, k AS n_neighbors, score FROM lof JOIN truths USING (a)"


# --- isolation forest: integer draws, boxes and cuts, one level after the other ---

FOREST_TREES, FOREST_SAMPLE, FOREST_LEVELS, FOREST_SEED = 300, 256, 8, 42


def _spread(value: str, name: str) -> str:
    """Columns that end in ``name``: the value scattered over 0 .. 2147483646."""
    p = 2147483647
    return (
        f"(CAST({value} AS BIGINT) + 1315423911) % {p} AS {name}_a, ({name}_a * {name}_a % {p} * 48271 + 11) % {p} AS {name}_b, "
        f"{name}_b * {name}_b % {p} * 69621 % {p} AS {name}"
    )


_WIDTHS = sorted({(n, max(1, int(f * len(c)))) for n, c in FEATURE_SETS.items() for f in FOREST_SHARES})
CTES["forest_vecs"] = "\n  " + "\n  UNION ALL ".join(
    f"SELECT '{n}' AS fs, order_date, is_true_anomaly AS truth, "
    f"[{', '.join(f'CAST(round({c} * 1000000) AS BIGINT)' for c in cols)}] AS v FROM scaled"
    for n, cols in FEATURE_SETS.items()
)
CTES["forest_picks"] = f"""
  SELECT t, order_date FROM (
    SELECT t, order_date, row_number() OVER (PARTITION BY t ORDER BY d, order_date) AS place FROM (
      SELECT t, order_date, {_spread(f"t + {FOREST_SEED}", "s")},
             {_spread("s + date_diff('day', DATE '1970-01-01', order_date)", "d")}
      FROM features, (SELECT unnest(range({FOREST_TREES})) AS t)))
  WHERE place <= {FOREST_SAMPLE}"""
CTES["forest_units"] = f"""
  SELECT u, fs, n, width, t, base FROM (
    SELECT *, {_spread(f"{FOREST_SEED} + 1000 + salt * 10 + width", "w")}, {_spread("w + t", "base")}
    FROM (VALUES {", ".join(f"({i}, '{n}', {zlib.crc32(n.encode()) % 1_000_003}, {len(FEATURE_SETS[n])}, {w})"
                             for i, (n, w) in enumerate(_WIDTHS))}) x(u, fs, salt, n, width),
         (SELECT unnest(range({FOREST_TREES})) AS t))"""
CTES["forest_cols"] = f"""
  SELECT u, t, c FROM (
    SELECT u, t, c, width, row_number() OVER (PARTITION BY u, t ORDER BY d, c) AS place
    FROM (SELECT *, {_spread("base + 31 * c", "d")} FROM (SELECT *, unnest(range(1, n + 1)) AS c FROM forest_units)))
  WHERE place <= width"""
CTES["forest_s0"] = """
  SELECT u, fs, t, base, order_date, 1 AS node FROM forest_units JOIN forest_picks USING (t)"""
for _k in range(FOREST_LEVELS):
    CTES[f"forest_cut{_k}"] = f"""
  SELECT u, t, node, c, lo + (hi - lo) * (step % 1048576) // 1048576 AS cut FROM (
  SELECT u, t, node, arg_max(c, d) AS c, arg_max(lo, d) AS lo, arg_max(hi, d) AS hi, any_value(step) AS step
  FROM (SELECT *, {_spread("base + 4099 * node + 31 * c + 17", "d")}, {_spread("base + 4099 * node + 7", "step")}
        FROM (SELECT s.u, s.t, s.base, s.node, c.c, min(x.v[c.c]) AS lo, max(x.v[c.c]) AS hi
              FROM forest_s{_k} s JOIN forest_cols c ON s.u = c.u AND s.t = c.t
              JOIN forest_vecs x ON x.fs = s.fs AND x.order_date = s.order_date GROUP BY ALL)
        WHERE hi > lo)
  GROUP BY u, t, node)"""
    CTES[f"forest_s{_k + 1}"] = f"""
  SELECT s.u, s.fs, s.t, s.base, s.order_date, s.node * 2 + CAST(x.v[k.c] > k.cut AS INTEGER) AS node
  FROM forest_s{_k} s JOIN forest_cut{_k} k ON s.u = k.u AND s.t = k.t AND s.node = k.node
  JOIN forest_vecs x ON x.fs = s.fs AND x.order_date = s.order_date"""
CTES["forest_cuts"] = "\n  " + " UNION ALL ".join(
    f"SELECT u, t, node, c, cut FROM forest_cut{k}" for k in range(FOREST_LEVELS)
)
CTES["forest_leaves"] = f"""
  SELECT u, t, node, level * 1000000 + CASE WHEN n > 2 THEN
           CAST(round(1000000 * (2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)) AS BIGINT)
           WHEN n = 2 THEN 1000000 ELSE 0 END AS path
  FROM (SELECT u, t, node, level, CAST(count(*) AS DOUBLE) AS n
        FROM ({" UNION ALL ".join(f"SELECT u, t, node, {k} AS level FROM forest_s{k}" for k in range(FOREST_LEVELS + 1))})
        GROUP BY ALL) ANTI JOIN forest_cuts USING (u, t, node)"""


def _walk() -> str:
    rows = "SELECT u, t, p.order_date, p.truth, p.v, 1 AS node FROM forest_units JOIN forest_vecs p USING (fs)"
    for _ in range(FOREST_LEVELS):
        rows = (
            "SELECT w.u, w.t, w.order_date, w.truth, w.v, "
            "CASE WHEN k.node IS NULL THEN w.node ELSE w.node * 2 + CAST(w.v[k.c] > k.cut AS INTEGER) END AS node "
            f"FROM ({rows}) w LEFT JOIN forest_cuts k ON w.u = k.u AND w.t = k.t AND w.node = k.node"
        )
    return rows


CTES["forest_paths"] = f"""
  SELECT w.u, w.order_date, w.truth,
         {", ".join(f"CAST(sum(path) FILTER (WHERE w.t < {m}) AS BIGINT) AS n{m}" for m in FOREST_SIZES)}
  FROM ({_walk()}) w JOIN forest_leaves l ON w.u = l.u AND w.t = l.t AND w.node = l.node GROUP BY ALL"""
_NORMAL = "(CASE WHEN psi > 2 THEN 2 * (ln(psi - 1) + 0.5772156649015329) - 2 * (psi - 1) / psi ELSE 1.0 END)"
CTES["forest_scores"] = "\n  " + "\n  UNION ALL ".join(
    f"SELECT '{n}' AS feature_set, CAST({f} AS DOUBLE) AS max_features, {m} AS n_estimators, order_date, truth, "
    f"pow(2.0, -(n{m} / {m * 1000000}) / {_NORMAL}) AS score FROM forest_paths, "
    f"(SELECT CAST(least(count(*), {FOREST_SAMPLE}) AS DOUBLE) AS psi FROM features) "
    f"WHERE u = {_WIDTHS.index((n, max(1, int(f * len(c)))))}"
    for n, c in FEATURE_SETS.items() for f in FOREST_SHARES for m in FOREST_SIZES
)

# --- model_results ---


def _name(method: str) -> str:
    return " || ".join(
        p for lit, field in re.findall(r"([^{}]*)(?:\{(\w+)\})?", NAMES[method]) for p in
        ([f"'{lit}'"] if lit else []) + ([f"CAST({field} AS VARCHAR)"] if field else [])
    )


PARAMS = {
    "contamination": "DOUBLE", "n_estimators": "DOUBLE", "max_features": "DOUBLE", "n_neighbors": "DOUBLE",
    "eps": "DOUBLE", "min_samples": "DOUBLE", "threshold": "DOUBLE", "window": "DOUBLE", "period": "DOUBLE",
    "span": "DOUBLE",
}


def family(method: str, cells: str, params: list[str], scaler: str = "none") -> str:
    """Result rows of one family; ``cells`` yields the hyper-parameters, feature_set, n, tp and total_days."""
    typed = ", ".join(
        f'CAST({p if p in params else "NULL"} AS DOUBLE) AS "{p}"'.replace("CAST(window ", 'CAST("window" ')
        for p in PARAMS
    )
    sizes = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in FEATURE_SETS.items())
    return f"""
  SELECT *, CASE WHEN anomaly_pct BETWEEN 1 AND 15 THEN 'yes' ELSE 'no' END AS success
  FROM (SELECT {_name(method).replace("CAST(window ", 'CAST("window" ')} AS model, '{method}' AS method_type, feature_set,
               '{scaler}' AS scaler, CASE feature_set {sizes} ELSE 1 END AS n_features, {typed},
               n AS anomalies_detected, {ratio("n", "total_days", 1, 100)} AS anomaly_pct, total_days,
               tp AS true_positives
        FROM ({cells}))"""


def _threshold_cells(scores: str, thresholds, key: str = "", out: str = "", name: str = "threshold") -> str:
    group = f"feature_set, {key}" if key else "feature_set"
    shown = f", {key} AS {out}" if key else ""
    values = ", ".join(f"CAST({t} AS DOUBLE)" for t in thresholds)
    return (
        f"SELECT feature_set{shown}, {name}, count(*) FILTER (WHERE score > {name}) AS n, "
        f"count(*) FILTER (WHERE score > {name} AND truth = 1) AS tp, count(*) AS total_days "
        f"FROM {scores}, (SELECT unnest([{values}]) AS {name}) GROUP BY {group}, {name}"
    )


ST = SERIES_THRESHOLDS
CTES["grid_zscore"] = family("ZScore", _threshold_cells("z_scores", ZSCORE_THRESHOLDS), ["threshold"])
CTES["grid_rolling_z"] = family(
    "RollingZScore", _threshold_cells("rolling_scores", ST, "win", '"window"'), ["window", "threshold"]
)
CTES["grid_ewm"] = family("EWM_ZScore", _threshold_cells("ewm_scores", ST, "span", "span"), ["span", "threshold"])
CTES["grid_seasonal"] = family(
    "SeasonalResidual", _threshold_cells("seasonal_scores", ST, "period", "period"), ["period", "threshold"]
)
CTES["grid_iqr"] = family("IQR", _threshold_cells("iqr_scores", IQR_MULTIPLIERS), ["threshold"])
CTES["grid_mad"] = family("MAD", _threshold_cells("mad_scores", MAD_THRESHOLDS), ["threshold"])
_C = ", ".join(map(str, LOF_CONTAMINATION))
CTES["lof_cells"] = f"""
  SELECT feature_set, n_neighbors, contamination, count(*) FILTER (WHERE neg < cut) AS n,
         count(*) FILTER (WHERE neg < cut AND truth = 1) AS tp, count(*) AS total_days
  FROM (SELECT *, -round(score, 6) AS neg FROM lof_scores)
  JOIN (SELECT feature_set, n_neighbors, unnest(quantile_cont(-round(score, 6), [{_C}])) AS cut,
               unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in LOF_CONTAMINATION)}]) AS contamination
        FROM lof_scores GROUP BY 1, 2) USING (feature_set, n_neighbors)
  GROUP BY ALL"""
CTES["grid_lof"] = family(
    "LocalOutlierFactor", "SELECT * FROM lof_cells", ["n_neighbors", "contamination"], "standard"
)
_M = ", ".join(map(str, DBSCAN_MIN_SAMPLES))
CTES["grid_dbscan"] = family(
    "DBSCAN",
    "SELECT feature_set, eps, min_samples, count(*) FILTER (WHERE density < min_samples) AS n, "
    "count(*) FILTER (WHERE density < min_samples AND truth = 1) AS tp, count(*) AS total_days "
    f"FROM eps_density, (SELECT unnest([{_M}]) AS min_samples) GROUP BY feature_set, eps, min_samples",
    ["eps", "min_samples"],
    "standard",
)
CTES["forest_cells"] = f"""
  SELECT feature_set, max_features, n_estimators, contamination, count(*) FILTER (WHERE neg < cut) AS n,
         count(*) FILTER (WHERE neg < cut AND truth = 1) AS tp, count(*) AS total_days
  FROM (SELECT *, -round(score, 6) AS neg FROM forest_scores)
  JOIN (SELECT feature_set, max_features, n_estimators,
               unnest(quantile_cont(-round(score, 6), [{", ".join(map(str, FOREST_CONTAMINATION))}])) AS cut,
               unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in FOREST_CONTAMINATION)}]) AS contamination
        FROM forest_scores GROUP BY 1, 2, 3) USING (feature_set, max_features, n_estimators)
  GROUP BY ALL"""
CTES["grid_forest"] = family(
    "IsolationForest", "SELECT * FROM forest_cells", ["n_estimators", "contamination", "max_features"], "standard"
)
CTES["results"] = "\n  " + "\n  UNION ALL ".join(
    f"SELECT * FROM {t}" for t in ("grid_forest", "grid_lof", "grid_dbscan", "grid_zscore", "grid_rolling_z", "grid_ewm",
                                   "grid_seasonal", "grid_iqr", "grid_mad")
)


def query(body: str, stored: frozenset[str] = frozenset()) -> str:
    """``body`` preceded by the CTEs it needs, directly or through others, but for those that are ``stored`` as tables."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if name not in needed and name not in stored and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    kept = {n: " MATERIALIZED" if n.startswith("forest_") and n != "forest_cuts" else "" for n in needed}
    return "WITH " + ",\n".join(f"{n} AS{kept[n]} ({CTES[n]})" for n in needed) + "\n" + body.strip()
