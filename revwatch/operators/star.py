"""Star schema: order facts, item facts, customer and product dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.functions.numeric import MONEY, from_cents, ratio
from revwatch.functions.subquery import only_row
from revwatch.operators.global_order import exact_quantiles, quantile_name
from revwatch.session import materialize

# Statuses that count as revenue, and statuses that reports leave out.
VALID_STATUSES = ("delivered", "shipped", "invoiced", "processing")
EXCLUDED_STATUSES = ("cancelled", "unavailable")


def valid_orders(orders: DataFrame, statuses=VALID_STATUSES) -> DataFrame:
    return orders.filter(F.col("order_status").isin(*statuses))


def billable(df: DataFrame, excluded=EXCLUDED_STATUSES) -> DataFrame:
    """Deny-list filter; as with SQL ``NOT IN``, a NULL status is dropped."""
    return df.filter(~F.col("order_status").isin(*excluded))


def order_totals(items: DataFrame) -> DataFrame:
    """Value, freight, item count and distinct products of every order.

    Rows are dealt by order and product before anything is held: few items share both, so a hash table over a split of
    the scan would keep nearly all of its rows. The number is stated, else adaptive execution joins the parts again.
    """
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(partitions, "order_id", "product_id").groupBy("order_id").agg(
        from_cents(F.sum("price_cents")).alias("order_value"),
        from_cents(F.sum("freight_cents")).alias("freight_value"),
        F.count("order_item_id").alias("items_count"),
        F.countDistinct("product_id").alias("unique_products"),
    )


def fact_orders_all(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per order that has items, in every status; customers are looked up and may be missing.

    The customer side is not hinted: Spark broadcasts it below the size threshold, and beyond it joins by sort-merge,
    where adaptive execution splits a customer who holds a large part of the orders.
    """
    buyer = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    return (
        orders.join(order_totals(items), "order_id")
        .join(buyer, "customer_id", "left")
        .select(
            "order_id",
            F.col("customer_unique_id").alias("customer_id"),
            "order_date",
            "order_status",
            "order_value",
            "freight_value",
            "items_count",
            "unique_products",
            "customer_city",
            "customer_state",
        )
    )


def build_fact_orders(orders, items, customers, statuses=VALID_STATUSES) -> DataFrame:
    """Order facts of the accepted statuses; the filter runs before the joins."""
    return fact_orders_all(valid_orders(orders, statuses), items, customers)


def fact_order_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Item grain with the order's date and status, so that products can be reached from an order."""
    return items.join(orders.select("order_id", "order_status", "order_date"), "order_id")


def order_attribute_values(order_items: DataFrame, products: DataFrame, attribute) -> DataFrame:
    """One row per (order, product attribute): cents of value and freight of the order's items with that attribute."""
    sold = products.select("product_id", attribute.alias("attribute"))
    return (
        order_items.join(sold, "product_id")
        .groupBy("order_id", "attribute", "order_status")
        .agg(
            F.sum("price_cents").alias("value_cents"),
            F.sum("freight_cents").alias("freight_cents"),
        )
    )


def customer_spend(fact: DataFrame) -> DataFrame:
    """Per customer: first city and state (by date, then order id), orders, spend, and purchase range.

    ``order_id`` is the key of ``fact``, so counting rows equals counting distinct orders without a second shuffle.
    """
    first = F.min_by(F.struct("customer_city", "customer_state"), F.struct("order_date", "order_id"))
    return (
        fact.groupBy("customer_id")
        .agg(
            first.alias("home"),
            F.count("order_id").alias("total_orders"),
            F.sum("order_value").cast(MONEY).alias("total_spent"),
            F.min("order_date").alias("first_purchase"),
            F.max("order_date").alias("last_purchase"),
        )
        .select(
            "customer_id",
            F.col("home.customer_city").alias("city"),
            F.col("home.customer_state").alias("state"),
            "total_orders",
            "total_spent",
            ratio(F.col("total_spent"), F.col("total_orders"), 2).alias("avg_order_value"),
            "first_purchase",
            "last_purchase",
        )
    )


def spend_quantiles(spend: DataFrame, probs=(0.75, 0.95, 0.99), accuracy: int | None = None) -> DataFrame:
    """Exact quantiles of spend; with ``accuracy`` a sketch of that accuracy, in one aggregation."""
    if accuracy is None:
        return exact_quantiles(spend, "total_spent", probs)
    value = F.col("total_spent").cast("double")
    return spend.agg(*[F.percentile_approx(value, p, accuracy).alias(quantile_name(p)) for p in probs])


def assign_tier(spend: DataFrame, cuts: DataFrame) -> DataFrame:
    """Low up to the 75th percentile of spend, medium up to the 95th, high above; a spend of zero has no tier."""
    amount, cut = F.col("total_spent").cast("double"), only_row(cuts)
    tier = (
        F.when(amount <= 0, "nan")
        .when(amount <= cut["q75"], "low_value")
        .when(amount <= cut["q95"], "medium")
        .otherwise("high_value")
    )
    return spend.withColumn("tier", tier)


def build_dim_customers(fact: DataFrame) -> DataFrame:
    spend = materialize(customer_spend(fact), "customer_spend")  # read for the cuts and for the rows
    return assign_tier(spend, spend_quantiles(spend, (0.75, 0.95)))


def build_dim_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Products with at least one sale, with quantity, revenue and mean price and freight."""
    stats = (
        items.groupBy("product_id")
        .agg(
            F.count("order_item_id").alias("total_qty_sold"),
            F.sum("price_cents").alias("price"),
            F.sum("freight_cents").alias("freight"),
        )
        .select(
            "product_id",
            "total_qty_sold",
            from_cents(F.col("price")).alias("total_revenue"),
            ratio(F.col("price"), F.col("total_qty_sold") * 100, 2).alias("avg_price"),
            ratio(F.col("freight"), F.col("total_qty_sold") * 100, 2).alias("avg_freight"),
        )
    )
    return products.select("product_id", "category", "weight_g").join(stats, "product_id")


def orphan_customers(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Customer ids of the facts that the dimension does not hold."""
    return (
        fact.select("customer_id").distinct().join(dim_customers.select("customer_id"), "customer_id", "left_anti")
    )
