"""Business queries and the data frames behind the dashboard, the notebook and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.labels import context_label, weight_band, z_label
from revwatch.functions.numeric import mean, money, ratio, rounded_sum, share_pct
from revwatch.functions.subquery import only_row
from revwatch.operators.detectors.pointwise import sigma_band
from revwatch.operators.global_order import exact_quantiles, ntile, rank_globally
from revwatch.session import materialize
from revwatch.operators.star import billable, order_attribute_values

VALUE = "order_value"


def month_key(day: str = "order_date") -> Column:
    return F.date_format(day, "yyyy-MM")


def _value_stats(sum_digits: int = 0, mean_digits: int = 2, names=("orders", "revenue", "avg_order_value")):
    orders, revenue, average = names
    return [
        F.count("*").alias(orders),
        rounded_sum(F.col(VALUE), sum_digits).alias(revenue),
        mean(F.col(VALUE), mean_digits).alias(average),
    ]


# --- named SQL queries ---


def monthly_growth(fact: DataFrame) -> DataFrame:
    """Monthly revenue, orders, mean order value and growth over the previous month that has orders."""
    months = Window.orderBy("month")  # one row per month
    previous = F.lag("total").over(months)
    return (
        billable(fact)
        .groupBy(month_key().alias("month"))
        .agg(F.sum(VALUE).alias("total"), *_value_stats(2, names=("total_orders", "revenue", "avg_order_value")))
        .select(
            "month", "revenue", "total_orders", "avg_order_value",
            ratio(F.col("total") - previous, previous, 1, 100).alias("mom_growth_pct"),
        )
    )


def monthly_growth_prev(fact: DataFrame) -> DataFrame:
    months = Window.orderBy("month")  # one row per month
    monthly = billable(fact).groupBy(month_key().alias("month")).agg(
        F.round(F.sum(VALUE), 2).alias("total"), F.count("*").alias("orders")
    )
    previous = F.lag("total").over(months)
    return monthly.select(
        "month",
        F.col("total").cast("double").alias("revenue"),
        "orders",
        previous.cast("double").alias("prev_month_revenue"),
        ratio(F.col("total") - previous, previous, 1, 100).alias("mom_growth_pct"),
    )


def delivered_spend(fact: DataFrame) -> DataFrame:
    return (
        fact.filter(F.col("order_status") == "delivered")
        .groupBy("customer_id")
        .agg(F.sum(VALUE).alias("total_spent"))
    )


def pareto_quintiles(fact: DataFrame) -> DataFrame:
    """Revenue share of each fifth of the customers, by spend; ties go to the lower customer id."""
    spend = materialize(delivered_spend(fact), "delivered_spend")
    ranked = rank_globally(spend, [F.desc("total_spent"), F.asc("customer_id")])
    fifths = ranked.groupBy(ntile(5).alias("quintile")).agg(
        F.count("*").alias("customers"), F.sum("total_spent").alias("spent")
    )
    whole = Window.partitionBy()  # five rows
    return fifths.select(
        "quintile",
        "customers",
        F.round("spent", 0).cast("double").alias("segment_revenue"),
        ratio(F.col("spent"), F.sum("spent").over(whole), 1, 100).alias("pct_of_total"),
    )


def zscore_alerts(daily: DataFrame, threshold: float = 2.5) -> DataFrame:
    return (
        daily.filter(F.abs("z_score") > threshold)
        .select(
            "order_date", "daily_revenue", "order_count", "z_score",
            z_label(F.col("z_score"), threshold).alias("anomaly_type"),
        )
        .orderBy(F.desc(F.abs("z_score")), "order_date")
    )


def _rolling_mean(digits: int) -> Column:
    week = Window.orderBy("order_date").rowsBetween(-6, Window.currentRow)  # one row per day
    revenue = F.col("daily_revenue").cast("decimal(18,2)")
    return ratio(F.sum(revenue).over(week), F.count(revenue).over(week), digits)


def rolling_deviation(daily: DataFrame, limit: int = 15) -> DataFrame:
    """Days farthest from their trailing seven-row mean."""
    week = Window.orderBy("order_date").rowsBetween(-6, Window.currentRow)
    revenue = F.col("daily_revenue").cast("decimal(18,2)")
    rows, total = F.count(revenue).over(week), F.sum(revenue).over(week)
    return (
        daily.select(
            "order_date",
            "daily_revenue",
            _rolling_mean(2).alias("rolling_7d_avg"),
            ratio(revenue * rows - total, rows, 2).alias("deviation_from_avg"),
        )
        .orderBy(F.desc(F.abs("deviation_from_avg")), "order_date")
        .limit(limit)
    )


def anomaly_context(daily: DataFrame) -> DataFrame:
    """Flagged days with their neighbours; neighbours are taken before the flag filter."""
    days = Window.orderBy("order_date")  # one row per day
    revenue = F.col("daily_revenue").cast("decimal(18,2)")
    return (
        daily.withColumns(
            {
                "prev_day_rev": F.lag("daily_revenue").over(days),
                "next_day_rev": F.lead("daily_revenue").over(days),
                "day_over_day_change": F.round(revenue - F.lag(revenue).over(days), 0).cast("double"),
                "rolling_7d_avg": _rolling_mean(0),
            }
        )
        .filter(F.col("anomaly_flag") == 1)
        .select(
            "order_date", "daily_revenue", "rolling_7d_avg", "prev_day_rev", "next_day_rev", "day_over_day_change",
            context_label(F.col("daily_revenue"), F.col("rolling_7d_avg")).alias("pattern"),
        )
    )


def best_config(results: DataFrame) -> DataFrame:
    """Per method, the configuration closest to 5 % flagged; ties by name, then feature set."""
    deviation = F.abs(F.col("anomaly_pct").cast("decimal(18,1)") - 5)
    order = Window.partitionBy("method_type").orderBy("deviation", "model", "feature_set")
    return (
        results.withColumn("deviation", deviation)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") == 1)
        .select(
            "method_type", "model", "feature_set", "scaler", "anomaly_pct",
            F.col("deviation").cast("double").alias("deviation_from_5pct_target"),
        )
    )


def feature_effectiveness(results: DataFrame, min_configs: int = 5, limit: int = 20) -> DataFrame:
    reasonable = F.col("anomaly_pct").between(3, 10)
    return (
        results.groupBy("method_type", "feature_set")
        .agg(
            F.count("*").alias("configs_tested"),
            F.count_if(reasonable).alias("reasonable_configs"),
            share_pct(reasonable).alias("success_rate_pct"),
        )
        .filter(F.col("configs_tested") > min_configs)
        .orderBy(F.desc("success_rate_pct"), "method_type", "feature_set")
        .limit(limit)
    )


def _spend_with_state(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Orders and spend per customer with the customer's state. Orders are summed per customer before the join, so a
    customer with very many orders meets the dimension as one row."""
    per_customer = fact.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum(VALUE).alias("spent"))
    return per_customer.join(dim_customers.select("customer_id", "state"), "customer_id")


def state_segments(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    delivered = _spend_with_state(fact.filter(F.col("order_status") == "delivered"), dim_customers)
    return delivered.groupBy("state").agg(
        F.count("customer_id").alias("unique_customers"),
        F.sum("n").alias("total_orders"),
        ratio(F.sum("spent"), F.sum("n"), 2).alias("avg_order_value"),
        rounded_sum(F.col("spent"), 0).alias("total_revenue"),
        ratio(F.sum("n"), F.count("customer_id"), 1).alias("orders_per_customer"),
    )


def dow_orders(fact: DataFrame) -> DataFrame:
    return (
        billable(fact)
        .groupBy((F.dayofweek("order_date") - 1).alias("dow"), F.date_format("order_date", "EEEE").alias("day_of_week"))
        .agg(*_value_stats(names=("orders", "total_revenue", "avg_value")))
    )


def cancel_rate(values: DataFrame, min_orders: int = 10) -> DataFrame:
    """``values`` is ``order_attribute_values`` by category, as for the category reports below."""
    cancelled = F.col("order_status") == "cancelled"
    return (
        values.groupBy(F.col("attribute").alias("category"))
        .agg(
            F.count("*").alias("total_orders"),
            F.count_if(cancelled).alias("cancelled"),
            share_pct(cancelled).alias("cancel_rate_pct"),
        )
        .filter(F.col("total_orders") > min_orders)
    )


def freight_by_weight(order_items: DataFrame, products: DataFrame) -> DataFrame:
    delivered = order_items.filter(F.col("order_status") == "delivered")
    return (
        order_attribute_values(delivered, products, weight_band(F.col("weight_g")))
        .groupBy(F.col("attribute").alias("weight_category"))
        .agg(
            F.count("*").alias("orders"),
            ratio(F.sum("freight_cents"), F.count("*") * 100, 2).alias("avg_freight"),
            ratio(F.sum("value_cents"), F.count("*") * 100, 2).alias("avg_order_value"),
            # Both means share the row count, so their ratio is the ratio of the sums.
            ratio(F.sum("freight_cents"), F.sum("value_cents"), 1, 100).alias("freight_pct_of_order"),
        )
    )


# --- dashboard, notebook and report frames ---


def category_values(values: DataFrame, mean_digits: int = 0) -> DataFrame:
    """Orders, revenue and mean value by category, over orders that count."""
    return (
        billable(values)
        .groupBy(F.col("attribute").alias("category"))
        .agg(
            F.count("*").alias("order_count"),
            ratio(F.sum("value_cents"), F.lit(100), 0).alias("total_revenue"),
            ratio(F.sum("value_cents"), F.count("*") * 100, mean_digits).alias("avg_order_value"),
        )
    )


def category_revenue(values: DataFrame) -> DataFrame:
    return category_values(values).select("category", F.col("total_revenue").alias("revenue"))


def category_pareto(values: DataFrame, upto: float | None = None) -> DataFrame:
    """Categories by revenue with cumulative share; ``upto`` keeps the head of the list."""
    ranked = Window.orderBy(F.desc("total_revenue"), "category")  # one row per category
    running = F.sum("total_revenue").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = category_values(values).withColumn(
        "cumulative_pct",
        F.round(F.try_divide(running, F.sum("total_revenue").over(Window.partitionBy())) * 100, 4),
    )
    return out if upto is None else out.filter(F.col("cumulative_pct") <= upto)


def category_tree(dim_products: DataFrame, limit: int = 15) -> DataFrame:
    return (
        dim_products.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.sum("total_revenue").cast("double").alias("total_revenue"),
            F.count("product_id").alias("num_products"),
            mean(money("avg_price"), 4).alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "category")
        .limit(limit)
    )


def state_revenue(fact: DataFrame, limit: int = 15) -> DataFrame:
    whole = Window.partitionBy()  # one row per state
    return (
        fact.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(F.sum(VALUE).alias("total"), F.count("order_id").alias("total_orders"), mean(F.col(VALUE)).alias("avg_order_value"))
        .select(
            "customer_state",
            F.col("total").cast("double").alias("total_revenue"),
            "total_orders",
            "avg_order_value",
            ratio(F.col("total"), F.sum("total").over(whole), 1, 100).alias("revenue_pct"),
        )
        .orderBy(F.desc("total_revenue"), "customer_state")
        .limit(limit)
    )


def state_totals(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    return _spend_with_state(billable(fact), dim_customers).groupBy("state").agg(
        F.sum("n").alias("orders"),
        rounded_sum(F.col("spent"), 0).alias("revenue"),
        ratio(F.sum("spent"), F.sum("n"), 0).alias("avg_order_value"),
    )


def top_states(fact: DataFrame, dim_customers: DataFrame, limit: int = 8) -> DataFrame:
    return (
        state_totals(fact, dim_customers)
        .select("state", "revenue")
        .orderBy(F.desc("revenue"), "state")
        .limit(limit)
    )


def _ranked_customers(dim_customers: DataFrame, running=None) -> DataFrame:
    spend = dim_customers.select("customer_id", "total_spent")
    return rank_globally(spend, [F.desc("total_spent"), F.asc("customer_id")], running)


def pareto_curve(dim_customers: DataFrame) -> DataFrame:
    """Customers by spend with cumulative revenue and customer percentages."""
    return _ranked_customers(dim_customers, {"cumulative_revenue": F.col("total_spent")}).select(
        "customer_id",
        "total_spent",
        F.col("position").alias("rank"),
        "cumulative_revenue",
        ratio(F.col("cumulative_revenue"), F.col("cumulative_revenue_total"), 4, 100).alias("cumulative_pct"),
        ratio(F.col("position"), F.col("n_total"), 4, 100).alias("customer_pct"),
    )


def top20_share(dim_customers: DataFrame, pct: int = 20) -> DataFrame:
    """Revenue share of the customers whose rank is within the first ``pct`` percent."""
    ranked = _ranked_customers(dim_customers)
    inside = F.col("position") * 100 <= F.col("n_total") * pct
    return ranked.agg(
        F.count_if(inside).alias("customers"),
        ratio(F.sum(F.when(inside, F.col("total_spent"))), F.sum("total_spent"), 1, 100).alias("revenue_pct"),
    )


def customer_split(dim_customers: DataFrame, share: float = 0.2) -> DataFrame:
    """Revenue of the first int(n * share) customers and of the rest."""
    top = F.col("position") <= F.floor(F.col("n_total") * F.lit(share))
    segment = F.when(top, "Top 20% Customers").otherwise("Bottom 80% Customers")
    return (
        _ranked_customers(dim_customers)
        .groupBy(segment.alias("segment"))
        .agg(F.count("*").alias("customers"), F.sum("total_spent").cast("double").alias("revenue"))
    )


def tier_counts(dim_customers: DataFrame) -> DataFrame:
    return dim_customers.groupBy("tier").agg(F.count("*").alias("customers"))


def month_of_year(fact: DataFrame) -> DataFrame:
    return (
        billable(fact)
        .groupBy(F.date_format("order_date", "MM").alias("month_num"))
        .agg(*_value_stats(0, 0, ("order_count", "revenue", "avg_order_value")))
    )


def seasonal_month_check(fact: DataFrame, month: str = "08") -> DataFrame:
    """One month of the year against the mean month."""
    months = month_of_year(fact)
    pick = F.col("month_num") == month

    def of(name: str) -> Column:
        return F.max(F.when(pick, F.col(name)))

    def deviation(name: str) -> Column:
        return F.round((F.try_divide(of(name), F.avg(name)) - 1) * 100, 4)

    return months.agg(
        F.lit(month).alias("month_num"),
        of("order_count").alias("order_count"),
        of("revenue").alias("revenue"),
        F.round(F.avg("order_count"), 4).alias("avg_orders"),
        F.round(F.avg("revenue"), 4).alias("avg_revenue"),
        deviation("order_count").alias("order_deviation_pct"),
        deviation("revenue").alias("revenue_deviation_pct"),
    )


def monthly_kpis(daily: DataFrame) -> DataFrame:
    return daily.groupBy(month_key().alias("month")).agg(
        F.sum(F.col("daily_revenue").cast("decimal(18,2)")).cast("double").alias("total_revenue"),
        F.sum("order_count").alias("total_orders"),
    )


def dow_revenue_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy(
        F.date_format("order_date", "EEEE").alias("dow"), F.weekday("order_date").alias("dow_num")
    ).agg(
        mean(money("daily_revenue"), 4).alias("mean"),
        F.round(F.stddev_samp("daily_revenue"), 4).alias("std"),
        F.round(F.median("daily_revenue"), 4).alias("median"),
    )


def revenue_ma(daily: DataFrame) -> DataFrame:
    days = Window.orderBy("order_date")  # one row per day
    revenue = F.col("daily_revenue").cast("decimal(18,2)")

    def trailing(rows: int) -> Column:
        w = days.rowsBetween(-(rows - 1), Window.currentRow)
        return ratio(F.sum(revenue).over(w), F.count(revenue).over(w), 4)

    return daily.select(
        "order_date",
        "daily_revenue",
        trailing(7).alias("revenue_ma7"),
        trailing(30).alias("revenue_ma30"),
        "is_true_anomaly",
        "event_label",
    )


def gt_listing(daily: DataFrame) -> DataFrame:
    """Labelled days with their direction, and the totals on every row."""
    whole = Window.partitionBy()  # labelled days
    z = F.col("z_score")
    return daily.filter(F.col("is_true_anomaly") == 1).select(
        "order_date",
        F.when(z > 0, "📈 SPIKE").otherwise("📉 DROP").alias("direction"),
        "z_score",
        "daily_revenue",
        "event_label",
        F.count("*").over(whole).alias("total_events"),
        F.count_if(z > 0).over(whole).alias("spikes"),
        F.count_if(z < 0).over(whole).alias("drops"),
    )


def order_value_hist(fact: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of order value, in decimal arithmetic; the last bin includes the maximum."""
    span = only_row(fact.agg(F.min(VALUE).alias("low"), F.max(VALUE).alias("high")))
    index = F.expr(f"coalesce(least(({VALUE} - low) * {bins} div nullif(high - low, 0), {bins - 1}), 0)")

    def edge(i: Column) -> Column:
        return ratio(F.col("low") * bins + i * (F.col("high") - F.col("low")), F.lit(bins), 4)

    return (
        fact.select(VALUE, span["low"].alias("low"), span["high"].alias("high"))
        .groupBy(index.cast("bigint").alias("bin"), "low", "high")
        .agg(F.count("*").alias("orders"))
        .select(
            "bin",
            edge(F.col("bin").cast("int")).alias("bin_start"),
            edge(F.col("bin").cast("int") + 1).alias("bin_end"),
            "orders",
        )
    )


def boxplot_stats(results: DataFrame, value: str = "anomaly_pct", key: str = "method_type") -> DataFrame:
    """Five-number summary and rows outside the 1.5 IQR fence, per key."""
    five = results.groupBy(key).agg(
        F.percentile(value, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    )
    q1, q3 = F.col("q")[1], F.col("q")[3]
    reach = (q3 - q1) * 1.5
    outlier = (F.col(value) < q1 - reach) | (F.col(value) > q3 + reach)
    return (
        results.select(key, value)
        .join(five, key)
        .groupBy(key)
        .agg(F.first("q").alias("q"), F.count_if(outlier).alias("outliers"))
        .select(
            key,
            *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))],
            "outliers",
        )
    )


def order_value_box(fact: DataFrame) -> DataFrame:
    """Five numbers of order value and the orders outside the 1.5 IQR fence, over all orders."""
    value = F.col(VALUE).cast("double")
    box = only_row(exact_quantiles(fact, VALUE, [0.25, 0.5, 0.75]))
    reach = (box["q75"] - box["q25"]) * 1.5
    outside = (value < box["q25"] - reach) | (value > box["q75"] + reach)
    return fact.select(
        value.alias("value"), outside.alias("outside"), *[box[q].alias(q) for q in ("q25", "q50", "q75")]
    ).agg(
        F.count("*").alias("orders"),
        F.min("value").alias("low"),
        *[F.round(F.max(q), 4).alias(n) for q, n in (("q25", "q1"), ("q50", "median"), ("q75", "q3"))],
        F.max("value").alias("high"),
        F.count_if("outside").alias("outliers"),
    )


def _one(df: DataFrame, **columns: Column) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in columns.items()])


def kpi_cards(fact: DataFrame, daily: DataFrame) -> DataFrame:
    """Orders, revenue, flagged days and days, as (metric, value)."""
    included = F.when(~F.col("order_status").isin("cancelled", "unavailable"), F.col(VALUE))
    orders = _one(
        fact, orders=F.count("*").cast("double"), revenue=F.coalesce(rounded_sum(included, 0), F.lit(0.0))
    )
    days = _one(
        daily, anomaly_days=F.count_if(F.col("anomaly_flag") == 1).cast("double"), days=F.count("*").cast("double")
    )
    return orders.unpivot([], orders.columns, "metric", "value").unionByName(
        days.unpivot([], days.columns, "metric", "value")
    )


def daily_split(daily: DataFrame) -> DataFrame:
    flagged = F.col("anomaly_flag") == 1
    return daily.select(
        "order_date",
        F.when(~flagged, F.col("daily_revenue")).alias("normal_revenue"),
        F.when(flagged, F.col("daily_revenue")).alias("anomaly_revenue"),
    )


def report_monthly_avg(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.month("order_date").alias("month_num"), F.date_format("order_date", "MMM").alias("month")).agg(
        ratio(F.sum(F.col("daily_revenue").cast("decimal(18,2)")), F.count("daily_revenue"), 2).alias("avg_revenue")
    )


def report_kpis(fact: DataFrame, daily: DataFrame, results: DataFrame) -> DataFrame:
    """Headline numbers of the report: revenue, days outside the band, best method and its success rate."""
    best = (
        results.groupBy("method_type")
        .agg(share_pct(F.col("anomaly_pct").between(3, 10)).alias("rate"))
        .orderBy(F.desc("rate"), "method_type")
        .limit(1)
    )
    top = only_row(best)
    outside = only_row(sigma_band(daily).agg(F.count("*").alias("days")))
    return fact.agg(F.sum(VALUE).cast("double").alias("total_revenue")).select(
        "total_revenue",
        outside["days"].alias("anomaly_days"),
        top["method_type"].alias("best_method"),
        top["rate"].alias("best_rate"),
    )
