"""Constants of the equivalent SQL, stated apart from the engine's, so that a wrong one cannot agree with itself."""

from __future__ import annotations

import math

# The columns of each named feature set.
FEATURE_SETS = {
    "revenue_only": ["daily_revenue"],
    "rev_orders": ["daily_revenue", "order_count"],
    "rev_freight": ["daily_revenue", "avg_freight"],
    "multi_feature": ["daily_revenue", "order_count", "avg_order_value", "avg_freight"],
    "temporal_basic": ["daily_revenue", "revenue_ma7", "revenue_diff"],
    "temporal_full": [
        "daily_revenue", "order_count", "revenue_ma7", "revenue_ma30", "revenue_std7", "revenue_diff",
    ],
    "all_features": [
        "daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_std7",
        "revenue_diff", "day_of_week",
    ],
}

# The hyper-parameters of the grid.
ZSCORE_THRESHOLDS = (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0)
ZSCORE_FEATURES = ("daily_revenue", "order_count", "avg_order_value", "avg_freight", "revenue_ma7", "revenue_diff")
SERIES_THRESHOLDS = (1.5, 2.0, 2.5, 3.0, 3.5)
SERIES_WINDOWS = (5, 7, 10, 14, 21, 30, 45)
SERIES_FEATURES = ("daily_revenue", "order_count", "avg_order_value")
SEASON_PERIODS = (7, 14, 21, 30, 60)
IQR_MULTIPLIERS = (1.5, 2.0, 2.5, 3.0)
MAD_THRESHOLDS = (2.5, 3.0, 3.5)
MAD_SCALE = 1.4826
LOF_NEIGHBORS = (5, 10, 15, 20, 25, 30, 40)
LOF_CONTAMINATION = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15)
DBSCAN_EPS = (0.3, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0)
DBSCAN_MIN_SAMPLES = (2, 3, 5, 7, 10, 15, 20)
FOREST_SIZES = (50, 100, 150, 200, 300)
FOREST_SHARES = (0.5, 0.75, 1.0)
FOREST_CONTAMINATION = (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.08, 0.1, 0.12, 0.15)
SWEEP = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0)

# How models are named.
NAMES = {
    "IsolationForest": "IF_n{n_estimators}_c{contamination}_mf{max_features}",
    "LocalOutlierFactor": "LOF_k{n_neighbors}_c{contamination}",
    "DBSCAN": "DBSCAN_eps{eps}_ms{min_samples}",
    "ZScore": "Z_t{threshold}",
    "RollingZScore": "RollingZ_w{window}_t{threshold}",
    "SeasonalResidual": "Seasonal_p{period}_t{threshold}",
    "EWM_ZScore": "EWM_s{span}_t{threshold}",
    "IQR": "IQR_t{threshold}",
    "MAD": "MAD_t{threshold}",
}

# Trigger words of the question templates, in the order in which they are tried.
RULES = (
    ("anomalies", (("anomaly", "anomalies", "unusual", "spike", "alert"),)),
    ("models", (("model", "algorithm", "method"), ("best", "compare", "performance", "rate", "which"))),
    ("monthly", (("revenue", "sales"), ("month", "trend", "total"))),
    ("category", (("category", "product", "categories"),)),
    ("state", (("state", "region", "location", "city", "where"),)),
    ("status", (("status", "cancelled", "delivered", "shipped"),)),
    ("features", (("feature", "scaler", "scaling"),)),
    ("zscore", (("z-score", "zscore", "z score", "threshold"),)),
    ("top_days", (("top", "highest", "best day", "peak"),)),
    ("worst_days", (("worst", "lowest", "bottom", "least"),)),
)

# Columns whose NULLs make a row incomplete.
REQUIRED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_tax"),
    "customer": ("c_custkey", "c_nationkey", "c_mktsegment"),
    "part": ("p_partkey", "p_type", "p_size"),
    "nation": ("n_nationkey", "n_name"),
    "region": ("r_regionkey", "r_name"),
    "supplier": ("s_suppkey", "s_nationkey"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "events": ("event_id", "ts", "user_id", "event_type", "value"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def ewm_rows(span: int) -> int:
    """Rows back at which an exponential weight has fallen to 1e-16."""
    return math.ceil(-16 * math.log(10) / math.log1p(-2 / (span + 1)))


def poisson_cumulated(steps: int = 12) -> list[float]:
    """Chances of at most 0, 1, 2, ... under a Poisson law of mean 1."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(steps)]
