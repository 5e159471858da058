"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in fields])


ORDERS_CSV = _schema(
    ("order_id", StringType),
    ("customer_id", StringType),
    ("order_status", StringType),
    ("order_purchase_timestamp", TimestampType),
)
ITEMS_CSV = _schema(
    ("order_id", StringType),
    ("order_item_id", IntegerType),
    ("product_id", StringType),
    ("price", DoubleType),
    ("freight_value", DoubleType),
)
CUSTOMERS_CSV = _schema(
    ("customer_id", StringType),
    ("customer_unique_id", StringType),
    ("customer_city", StringType),
    ("customer_state", StringType),
)
PRODUCTS_CSV = _schema(
    ("product_id", StringType),
    ("product_category_name", StringType),
    ("product_weight_g", DoubleType),
)

GROUND_TRUTH = _schema(
    ("anomaly_date", DateType),
    ("event_label", StringType),
    ("anomaly_type", StringType),
    ("severity", StringType),
)

MODEL_RESULTS = _schema(
    ("model", StringType),
    ("method_type", StringType),
    ("feature_set", StringType),
    ("scaler", StringType),
    ("n_features", IntegerType),
    ("contamination", DoubleType),
    ("n_estimators", IntegerType),
    ("max_features", DoubleType),
    ("n_neighbors", IntegerType),
    ("eps", DoubleType),
    ("min_samples", IntegerType),
    ("threshold", DoubleType),
    ("window", IntegerType),
    ("period", IntegerType),
    ("span", IntegerType),
    ("anomalies_detected", LongType),
    ("anomaly_pct", DoubleType),
    ("total_days", LongType),
    ("true_positives", LongType),
    ("success", StringType),
)
