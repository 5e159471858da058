"""Scalar subqueries: how a one-row aggregate meets a table without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_row(df: DataFrame) -> Column:
    """The row of a one-row frame as a struct column; read its fields with ``[name]``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()
