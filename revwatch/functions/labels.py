"""Label expressions over KPI values and anomaly rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REASONABLE_BAND = (3, 10)
SUCCESS_BAND = (1, 15)
BROKEN_ABOVE = 20


def rate_class(pct: Column) -> Column:
    return (
        F.when(pct < 1, "too_conservative")
        .when(pct < 3, "conservative")
        .when(pct <= 10, "reasonable")
        .when(pct <= 20, "aggressive")
        .otherwise("broken")
    )


def quality(pct: Column) -> Column:
    return F.when(pct.between(*REASONABLE_BAND), "reasonable").when(pct > BROKEN_ABOVE, "broken").otherwise("suboptimal")


def success(pct: Column, band=SUCCESS_BAND) -> Column:
    return F.when(pct.between(*band), "yes").otherwise("no")


def z_label(z: Column, threshold: float = 2.5, names=("SPIKE", "DROP", "NORMAL")) -> Column:
    spike, drop, normal = names
    return F.when(z > threshold, spike).when(z < -threshold, drop).otherwise(normal)


# The texts of the context column.
def context_label(value: Column, baseline: Column, names=("🔴 Spike", "🔵 Drop", "✅ Normal")) -> Column:
    spike, drop, normal = names
    return F.when(value > baseline * 1.5, spike).when(value < baseline * 0.5, drop).otherwise(normal)


def weight_band(grams: Column) -> Column:
    """A missing weight falls through to the last band."""
    return F.when(grams < 1000, "Light (<1kg)").when(grams < 5000, "Medium (1-5kg)").otherwise("Heavy (>5kg)")


def param(model: Column | str, pattern: str) -> Column:
    """Number captured by ``pattern`` in a model name; NULL when the name does not carry it."""
    return F.nullif(F.regexp_extract(model, pattern, 1), F.lit("")).cast("double")


# How hyper-parameters are written inside a model name.
MODEL_PARAM_PATTERNS = {
    "eps": r"eps([\d.]+)",
    "min_samples": r"ms(\d+)",
    "contamination": r"c(0\.\d+)",
    "n_neighbors": r"_k(\d+)",
    "n_estimators": r"_n(\d+)",
    "max_features": r"_mf([\d.]+)",
    "threshold": r"_t([\d.]+)",
    "window": r"_w(\d+)",
    "period": r"_p(\d+)",
    "span": r"_s(\d+)",
}
