"""Dataset contract: which (table, column, type) a run expects, and what the files really hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwatch.sources.tables import read_parquet

EXPECTED = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_extendedprice": "double",
                 "l_tax": "double"},
    "customer": {"c_custkey": "bigint", "c_nationkey": "int", "c_mktsegment": "string"},
    "part": {"p_partkey": "bigint", "p_type": "string", "p_size": "int"},
    "nation": {"n_nationkey": "int", "n_name": "string"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "supplier": {"s_suppkey": "bigint", "s_nationkey": "int"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}

#: Rows that a complete build of the marketplace has at least; tables not named here must not be empty.
LEAST_ROWS = {"fact_orders": 90_000}

_ROW = "table_name string, column_name string, column_type string"


def actual_columns(spark: SparkSession, sf_dir: str, tables=tuple(EXPECTED)) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t in tables for f in read_parquet(spark, sf_dir, t).schema]
    return spark.createDataFrame(rows, _ROW)


def contract_violations(spark: SparkSession, sf_dir: str, expected=EXPECTED) -> DataFrame:
    """Expected columns that are absent or have another type."""
    rows = [(t, c, kind) for t, cols in expected.items() for c, kind in cols.items()]
    want = spark.createDataFrame(rows, _ROW)
    return want.join(actual_columns(spark, sf_dir, tuple(expected)), ["table_name", "column_name", "column_type"],
                     "left_anti")


def incomplete_rows(spark: SparkSession, sf_dir: str, expected=EXPECTED) -> DataFrame:
    """Per table: rows, and rows in which an expected column is NULL; columns the table lacks are left to the schema
    check."""
    out = None
    for name, cols in expected.items():
        table = read_parquet(spark, sf_dir, name)
        missing = F.lit(False)
        for c in cols:
            if c in table.columns:
                missing = missing | F.col(c).isNull()
        frame = table.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.count_if(missing).alias("incomplete_rows")
        )
        out = frame if out is None else out.unionByName(frame)
    return out


def contract_check(spark: SparkSession, sf_dir: str, expected=EXPECTED) -> DataFrame:
    """Per table: expected columns, how many are missing or mistyped, rows, and rows with a NULL in one of them."""
    sizes = spark.createDataFrame([(t, len(c)) for t, c in expected.items()], "table_name string, expected_columns int")
    bad = contract_violations(spark, sf_dir, expected).groupBy("table_name").agg(F.count("*").alias("violations"))
    return (
        incomplete_rows(spark, sf_dir, expected)
        .join(sizes, "table_name")
        .join(bad, "table_name", "left")
        .na.fill(0, ["violations"])
    )
