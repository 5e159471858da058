"""Question templates: ordered keyword rules, the first match decides which frame answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.labels import z_label
from revwatch.functions.numeric import mean, ratio, rounded_sum, share_pct
from revwatch.operators.rca import mean_pct
from revwatch.operators.star import billable, order_attribute_values
from revwatch.plans import business

# Rule order and trigger words. A rule fires when every one of its word groups has a word in the text.
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


def intent(question: Column) -> Column:
    text = F.lower(question)
    out = F.when(text.isNull() | text.rlike(r"^\s*$"), "empty")
    for name, groups in RULES:
        fires = F.lit(True)
        for words in groups:
            any_word = F.lit(False)
            for word in words:
                any_word = any_word | text.contains(word)
            fires = fires & any_word
        out = out.when(fires, name)
    return out.otherwise("overview")


def question_intents(questions: DataFrame, text: str = "text") -> DataFrame:
    """How many questions each rule answers."""
    return questions.groupBy(intent(F.col(text)).alias("intent")).agg(F.count("*").alias("questions"))


def _days(daily: DataFrame):
    return F.round(F.col("daily_revenue").cast("decimal(18,2)"), 0).cast("double").alias("revenue")


def ask_anomalies(daily: DataFrame) -> DataFrame:
    # The status texts.
    status = F.when(F.col("anomaly_flag") == 1, "🚨 Anomaly").otherwise("✅ Normal")
    return (
        daily.filter(F.col("anomaly_flag") == 1)
        .orderBy(F.desc(F.abs("z_score")), "order_date")
        .limit(10)
        .select("order_date", _days(daily), "order_count", "z_score", status.alias("status"))
    )


def ask_models(results: DataFrame) -> DataFrame:
    return results.groupBy("method_type").agg(
        F.count("*").alias("configs_tested"),
        share_pct(F.col("anomaly_pct").between(3, 10)).alias("success_rate_pct"),
        mean_pct(1).alias("avg_anomaly_pct"),
    )


def ask_monthly(fact: DataFrame) -> DataFrame:
    return (
        billable(fact)
        .groupBy(business.month_key().alias("month"))
        .agg(
            rounded_sum(F.col("order_value"), 0).alias("revenue"),
            F.count("*").alias("orders"),
            mean(F.col("order_value"), 0).alias("avg_order"),
        )
    )


def ask_category(values: DataFrame) -> DataFrame:
    return business.category_values(values).select(
        "category",
        F.col("order_count").alias("total_orders"),
        F.col("total_revenue").alias("revenue"),
        F.col("avg_order_value").alias("avg_order"),
    )


def ask_state(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    return (
        business.state_totals(fact, dim_customers)
        .withColumnRenamed("avg_order_value", "avg_order")
        .orderBy(F.desc("revenue"), "state")
        .limit(10)
    )


def ask_status(fact: DataFrame) -> DataFrame:
    per_status = fact.groupBy("order_status").agg(
        F.count("*").alias("orders"), rounded_sum(F.col("order_value"), 0).alias("revenue")
    )
    total = F.sum("orders").over(Window.partitionBy())  # one row per status
    return per_status.select(
        "order_status", "orders", "revenue", ratio(F.col("orders"), total, 1, 100).alias("pct_of_total")
    )


def ask_features(results: DataFrame) -> DataFrame:
    return (
        results.filter(~F.col("method_type").like("Statistical%"))
        .groupBy("feature_set", "scaler")
        .agg(
            F.count("*").alias("configs"),
            share_pct(F.col("anomaly_pct").between(3, 10)).alias("success_rate_pct"),
            mean_pct(1).alias("avg_anomaly_pct"),
        )
        .orderBy(F.desc("success_rate_pct"), "feature_set", "scaler")
        .limit(15)
    )


def ask_zscore(daily: DataFrame) -> DataFrame:
    # The status texts.
    status = z_label(F.col("z_score"), 2.5, ("📈 High Spike", "📉 Big Drop", "✅ Normal"))
    return (
        daily.filter(F.abs("z_score") > 2.0)
        .orderBy(F.desc(F.abs("z_score")), "order_date")
        .limit(10)
        .select("order_date", _days(daily), "z_score", status.alias("status"))
    )


def _days_by(daily: DataFrame, order: Column) -> DataFrame:
    return daily.orderBy(order, "order_date").limit(10).select("order_date", _days(daily), "order_count")


def ask_top_days(daily: DataFrame) -> DataFrame:
    return _days_by(daily, F.desc("daily_revenue"))


def ask_worst_days(daily: DataFrame) -> DataFrame:
    return _days_by(daily, F.asc("daily_revenue"))


def ask_overview(fact: DataFrame, daily: DataFrame, results: DataFrame) -> DataFrame:
    """Five overview numbers as text, one scan per table."""

    def whole(col: Column) -> Column:
        return F.round(col, 0).cast("decimal(28,0)").cast("string")

    counted = F.when(~F.col("order_status").isin("cancelled", "unavailable"), F.col("order_value"))
    parts = [
        fact.agg(
            F.count("*").cast("string").alias("Total Orders"), whole(F.sum(counted)).alias("Total Revenue")
        ),
        daily.agg(
            F.sum("anomaly_flag").cast("string").alias("Anomaly Days Detected"),
            F.count("*").cast("string").alias("Total Days Monitored"),
        ),
        results.agg(F.count("*").cast("string").alias("Models Tested")),
    ]
    long = [p.unpivot([], [F.col(f"`{c}`") for c in p.columns], "metric", "value") for p in parts]
    return long[0].unionByName(long[1]).unionByName(long[2])


def answer(question: str, *, fact, order_items, products, dim_customers, daily, results) -> DataFrame | None:
    """The frame that answers one question; None for an empty one. The text only selects a rule, it is never executed."""
    chosen = route(question)
    frames = {
        "anomalies": lambda: ask_anomalies(daily),
        "models": lambda: ask_models(results),
        "monthly": lambda: ask_monthly(fact),
        "category": lambda: ask_category(order_attribute_values(order_items, products, F.col("category"))),
        "state": lambda: ask_state(fact, dim_customers),
        "status": lambda: ask_status(fact),
        "features": lambda: ask_features(results),
        "zscore": lambda: ask_zscore(daily),
        "top_days": lambda: ask_top_days(daily),
        "worst_days": lambda: ask_worst_days(daily),
        "overview": lambda: ask_overview(fact, daily, results),
    }
    return frames[chosen]() if chosen in frames else None


def route(question: str) -> str:
    """Rule name of a single question, without a Spark job."""
    text = question.lower().strip()
    if not text:
        return "empty"
    for name, groups in RULES:
        if all(any(word in text for word in words) for words in groups):
            return name
    return "overview"
