"""Exact money arithmetic: items are summed as integer cents, order values as decimals, ratios are rounded half up once,
and doubles appear only at the edge.

Cents matter on the item table: sums of ``bigint`` stay in generated code, while sums of ``decimal(18,2)`` do not fit a
machine word and take twice the time.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def money(col: Column | str) -> Column:
    return F.col(col).cast(MONEY) if isinstance(col, str) else col.cast(MONEY)


def cents(value: Column) -> Column:
    """Integer cents of a double that carries two digits."""
    return F.rint(value * 100).cast("bigint")


def from_cents(amount: Column) -> Column:
    return (amount.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def ratio(num: Column, den: Column, scale: int, factor: int = 1) -> Column:
    """round(factor * num / den, scale) as double, computed in decimal; NULL when ``den`` is zero."""
    top = num.cast("decimal(24,4)") * F.lit(factor)
    bottom = F.nullif(den.cast("decimal(24,4)"), F.lit(0).cast("decimal(24,4)"))
    return F.round(top / bottom, scale).cast("double")


def mean(value: Column, scale: int = 2) -> Column:
    """Exact rounded mean of a money column, as an aggregate expression (NULL values are left out)."""
    return ratio(F.sum(value), F.count(value), scale)


def share_pct(condition: Column, scale: int = 1) -> Column:
    """Percentage of rows meeting ``condition``."""
    return ratio(F.count_if(condition), F.count(F.lit(1)), scale, 100)


def rounded_sum(value: Column, scale: int = 2) -> Column:
    return F.round(F.sum(value), scale).cast("double")


def safe_divide(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def publish(df: DataFrame) -> DataFrame:
    """Output edge: calendar dates become ``yyyy-MM-dd`` text and decimals become doubles."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd").alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("double").alias(field.name)
        out.append(col)
    return df.select(*out)
