"""The four source tables of the star schema, from order CSVs or from the wholesale parquet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.functions.numeric import cents
from revwatch.sources import schemas

STATUS_CODES = {"F": "delivered", "O": "shipped", "P": "cancelled"}
REQUIRED_INPUTS = ("orders", "items", "customers", "products")


@dataclass(frozen=True)
class Sources:
    orders: DataFrame  # order_id, customer_id, order_status, order_date
    items: DataFrame  # order_id, order_item_id, product_id, price_cents, freight_cents
    customers: DataFrame  # customer_id, customer_unique_id, customer_city, customer_state
    products: DataFrame  # product_id, category, weight_g


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Permissive CSV scan with a declared schema: columns by header name, others left out, and the raw line of every
    row that does not fit in ``CORRUPT``. Only columns that a query reads are parsed, and judged."""
    header = spark.read.option("header", True).csv(path).limit(0).columns
    full = ", ".join(
        f"`{c}` {schema[c].dataType.simpleString() if c in schema.names else 'string'}" for c in header
    )
    return (
        spark.read.schema(f"{full}, `{CORRUPT}` string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)  # else a line that ends early passes
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
        .select(*schema.names, CORRUPT)
    )


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a CSV scan; of a row that does not fit, the columns that do."""
    return scan_csv(spark, path, schema).drop(CORRUPT)


#: Columns that a row must have, and amounts that must not be negative.
REQUIRED_COLUMNS = {
    "orders": ("order_id", "customer_id", "order_purchase_timestamp"),
    "items": ("order_id", "order_item_id", "product_id", "price", "freight_value"),
    "customers": ("customer_id",),
    "products": ("product_id",),
}
AMOUNTS = {"items": ("price", "freight_value")}
CSV_SCHEMAS = {
    "orders": schemas.ORDERS_CSV,
    "items": schemas.ITEMS_CSV,
    "customers": schemas.CUSTOMERS_CSV,
    "products": schemas.PRODUCTS_CSV,
}


def _judged(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A CSV table with the first reason, if any, for which a row is rejected."""
    rows = scan_csv(spark, path, CSV_SCHEMAS[name])
    # A scan parses, and finds faults in, only what is read: the length makes every query read all columns.
    all_read = F.length(F.concat_ws(",", *[F.col(c).cast("string") for c in CSV_SCHEMAS[name].names])) >= 0
    reason = F.when(F.col(CORRUPT).isNotNull() & all_read, "does not parse")
    for column in REQUIRED_COLUMNS[name]:
        reason = reason.when(F.col(column).isNull(), f"no {column}")
    for column in AMOUNTS.get(name, ()):
        reason = reason.when(F.col(column) < 0, f"negative {column}")
    return rows.withColumn("reason", reason)


def missing_inputs(paths: Mapping[str, str]) -> list[str]:
    """Logical inputs for which no path was given."""
    return [name for name in REQUIRED_INPUTS if not paths.get(name)]


def from_csv(spark: SparkSession, paths: Mapping[str, str]) -> Sources:
    """Star-schema sources from CSV files, keyed by the logical names in ``REQUIRED_INPUTS``."""
    missing = missing_inputs(paths)
    if missing:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    tables = {name: read_csv(spark, paths[name], CSV_SCHEMAS[name]) for name in REQUIRED_INPUTS}
    return _star_sources(**tables)


def from_csv_checked(spark: SparkSession, paths: Mapping[str, str]) -> tuple[Sources, DataFrame]:
    """Star-schema sources of the rows that are fit, and all others as (table_name, reason, line).

    A row is rejected if it does not parse, lacks a required column or has a negative amount. ``line`` is the raw line
    of a row that does not parse, else its columns joined by commas.
    """
    missing = missing_inputs(paths)
    if missing:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    judged = {name: _judged(spark, name, paths[name]) for name in REQUIRED_INPUTS}
    good = {name: rows.filter("reason IS NULL").drop("reason", CORRUPT) for name, rows in judged.items()}
    rejects = None
    for name, rows in judged.items():
        values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CSV_SCHEMAS[name].names]
        line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *values))
        bad = rows.filter("reason IS NOT NULL").select(F.lit(name).alias("table_name"), "reason", line.alias("line"))
        rejects = bad if rejects is None else rejects.unionByName(bad)
    return _star_sources(**good), rejects


def _star_sources(orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame) -> Sources:
    return Sources(
        orders=orders.select(
            "order_id", "customer_id", "order_status", F.to_date("order_purchase_timestamp").alias("order_date")
        ),
        items=items.select(
            "order_id",
            "order_item_id",
            "product_id",
            cents(F.col("price")).alias("price_cents"),
            cents(F.col("freight_value")).alias("freight_cents"),
        ),
        customers=customers,
        products=products.withColumnsRenamed(
            {"product_category_name": "category", "product_weight_g": "weight_g"}
        ),
    )


def from_wholesale(spark: SparkSession, sf_dir: str, statuses: Sequence[str] | None = None) -> Sources:
    """Star-schema sources from the orders / lineitem / customer / nation / part tables.

    With ``statuses`` only orders of those statuses are read; the filter is on the stored code, so the scan takes it.
    """
    status = F.lit(None).cast("string")
    for code, name in STATUS_CODES.items():
        status = F.when(F.col("o_orderstatus") == code, name).otherwise(status)
    orders = read_parquet(spark, sf_dir, "orders")
    if statuses is not None:
        orders = orders.filter(F.col("o_orderstatus").isin([c for c, name in STATUS_CODES.items() if name in statuses]))
    orders = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.to_date("o_orderdate").alias("order_date"),
    )
    price, tax_pct = cents(F.col("l_extendedprice")), F.rint(F.col("l_tax") * 100).cast("bigint")
    items = read_parquet(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        price.alias("price_cents"),
        (price * tax_pct).alias("freight_hundredths"),
    )
    # Freight is price times tax, rounded half up to a cent.
    freight = F.expr("(freight_hundredths + 50) div 100").alias("freight_cents")
    items = items.select("order_id", "order_item_id", "product_id", "price_cents", freight)
    nation = read_parquet(spark, sf_dir, "nation")
    customers = (
        read_parquet(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )
    products = read_parquet(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        (F.col("p_size") * 200).cast("double").alias("weight_g"),
    )
    return Sources(orders, items, customers, products)
