"""Counters of a build, CSV scans with rejected rows, and re-runs that write what changed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from revwatch.operators import grid, star
from revwatch.operators.counters import BuildCounters
from revwatch.sources import incremental, tables

ORDERS = "order_id,customer_id,order_status,order_purchase_timestamp,extra\n" + "\n".join(
    ["o1,c1,delivered,2017-11-24 10:00:00,x", "o2,c2,shipped,not a date,x", ",c3,delivered,2017-11-25 01:00:00,x",
     "o4,c1,delivered,2017-11-26 01:00:00,x", '"o5,c1,delivered', "o6,c1,delivered,,x"]
)
ITEMS = "order_id,order_item_id,product_id,price,freight_value\n" + "\n".join(
    ["o1,1,p1,10.10,1.00", "o1,two,p2,20.20,2.00", "o4,1,p1,-5.00,1.00", "o4,2,p1,7.00,", "o4,3,p1,8.00,1.00", "o4,4,,1.00,1.00"]
)
CUSTOMERS = "customer_id,customer_unique_id,customer_city,customer_state\nc1,u1,X,SP\nc2,u1,Y,RJ\n"
PRODUCTS = "product_id,product_category_name,product_weight_g\np1,toys,500\np2,,heavy\np3,,\n"


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    out = {}
    for name, text in {"orders": ORDERS, "items": ITEMS, "customers": CUSTOMERS, "products": PRODUCTS}.items():
        (folder / f"{name}.csv").write_text(text)
        out[name] = str(folder / f"{name}.csv")
    return out


def test_rows_are_fit_or_rejected_with_a_reason(spark, paths):
    good, rejects = tables.from_csv_checked(spark, paths)
    assert sorted(r.order_id for r in good.orders.collect()) == ["o1", "o4"]
    assert sorted((r.order_id, r.order_item_id) for r in good.items.collect()) == [("o1", 1), ("o4", 3)]
    assert sorted(r.product_id for r in good.products.collect()) == ["p1", "p3"]
    found = sorted((r.table_name, r.reason) for r in rejects.collect())
    assert found == [
        ("items", "does not parse"), ("items", "negative price"), ("items", "no freight_value"), ("items", "no product_id"),
        ("orders", "does not parse"), ("orders", "does not parse"), ("orders", "no order_id"),
        ("orders", "no order_purchase_timestamp"), ("products", "does not parse"),
    ]
    lines = {r.line for r in rejects.collect()}
    assert "o2,c2,shipped,not a date,x" in lines and "p2,,heavy" in lines


def test_a_row_is_judged_the_same_whatever_is_read_of_it(spark, paths):
    """Counting, or reading one column, must not make a faulty row look fit."""
    good, rejects = tables.from_csv_checked(spark, paths)
    assert good.items.count() == 2 and good.items.select("price_cents").count() == 2 and rejects.count() == 9
    with pytest.raises(ValueError, match="items"):
        tables.from_csv_checked(spark, {"orders": "x"})


def test_counters_come_with_the_writes(spark, paths, tmp_path):
    good, _ = tables.from_csv_checked(spark, paths)
    seen = BuildCounters()
    facts = seen.facts(star.fact_orders_all(seen.orders(good.orders), good.items, good.customers))
    facts.write.parquet(str(tmp_path / "facts"))
    seen.products(star.build_dim_products(good.items, good.products)).write.parquet(str(tmp_path / "products"))
    assert {r.metric: r.value for r in seen.rows(spark).collect()} == {
        "orders_kept": 2, "orders_removed": 0, "fact_orders": 2, "date_span_days": 2, "products": 1, "product_categories": 1,
    }


def test_the_metrics_query_scans_nothing(warehouse, capsys):
    frame = warehouse.build_metrics()
    frame.explain()
    assert "FileScan" not in capsys.readouterr().out and frame.count() == 11


SCHEMA = "id bigint, day date, amount double, note string"


def facts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, path, like):
    return sorted(tuple(r) for r in incremental.read_months(spark, path, like).drop("month").collect())


def files(spark, path, like):
    read = incremental.read_months(spark, path, like).select("month", F.col("_metadata.file_path").alias("f")).distinct()
    out = {}
    for r in read.collect():
        out.setdefault(r.month, set()).add(r.f)
    return out


def test_runs_write_only_the_months_that_changed(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(k, dt.date(2024, 1 + k % 4, 1 + k % 28), float(k), None if k % 5 else "n") for k in range(200)]
    first = facts(spark, rows)
    assert incremental.write_changed_months(first, path, "day") == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert rows_of(spark, path, first) == sorted(rows)
    before = files(spark, path, first)
    assert incremental.write_changed_months(facts(spark, rows[::-1]).repartition(5), path, "day") == []
    assert files(spark, path, first) == before

    changed = [(i, d, a + (d.month == 3), n) for i, d, a, n in rows] + [(900, dt.date(2024, 6, 1), 1.0, "new")]
    assert incremental.write_changed_months(facts(spark, changed), path, "day") == ["2024-03", "2024-06"]
    assert rows_of(spark, path, first) == sorted(changed)
    after = files(spark, path, first)
    assert all(after[m] == before[m] for m in ("2024-01", "2024-02", "2024-04")) and after["2024-03"] != before["2024-03"]

    left = [r for r in changed if r[1].month != 2]
    assert incremental.write_changed_months(facts(spark, left), path, "day") == []
    assert rows_of(spark, path, first) == sorted(left)


def test_a_run_that_failed_is_done_again(spark, tmp_path):
    """Data of an earlier attempt stand, but its digests do not: the months are written again and counted once."""
    path = str(tmp_path / "facts")
    frame = facts(spark, [(1, dt.date(2024, 1, 1), 1.0, "a"), (2, None, 2.0, "b"), (2, None, 2.0, "b")])
    dated = frame.withColumn("month", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")))
    dated.write.partitionBy("month").parquet(f"{path}/data")
    assert incremental.write_changed_months(frame, path, "day") == ["2024-01", "none"]
    assert incremental.read_months(spark, path, frame).count() == 3
    assert incremental.write_changed_months(frame.limit(0), path, "day") == []
    assert incremental.stored_digests(spark, path).count() == 0


def test_catalog_listing(spark, tmp_path):
    path = str(tmp_path / "facts")
    frame = facts(spark, [(k, dt.date(2024, 1 + k, 1), 1.0, "a") for k in range(3)])
    incremental.write_changed_months(frame, path, "day")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS runs LOCATION '{tmp_path}/db'")
    incremental.register_months(spark, "runs", "facts", path, frame)
    more = facts(spark, [(k, dt.date(2024, 1 + k, 1), 1.0, "a") for k in range(5)])
    incremental.write_changed_months(more, path, "day")
    incremental.register_months(spark, "runs", "facts", path, frame)
    assert [tuple(r) for r in incremental.table_listing(spark, "runs").collect()] == [("facts", 5, 5)]
    assert spark.table("runs.facts").filter("month = '2024-05'").count() == 1


def test_coverage_shows_a_family_that_did_not_run(spark):
    results = spark.createDataFrame([("ZScore", 10)] * 3 + [("MAD", 10)], "method_type string, total_days bigint")
    rows = {r.method_type: (r.configs, r.defined_configs, r.total_days) for r in grid.grid_coverage(results).collect()}
    assert rows["ZScore"] == (3, 54, 10) and rows["MAD"] == (1, 0, 10) and rows["STL_Residual"] == (0, 75, None)
    assert sum(d for _, d, _ in rows.values()) == 2327
