"""CSV sources, sinks, global order, tiers, questions and quality rules."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from revwatch.operators import quality, rca, star
from revwatch.operators.calendar import MARKETPLACE_EVENTS, calendar_years, holiday_calendar, marketplace_calendar
from revwatch.operators.global_order import exact_quantiles, exact_quantiles_by, ntile, rank_globally
from revwatch.operators.kpis import build_daily_kpis, ground_truth, label_ground_truth
from revwatch.plans import questions
from revwatch.sources import sinks, tables

ROOT = Path(__file__).resolve().parent.parent

CSV = {
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,extra\n"
    "o1,c1,delivered,2017-11-24 10:00:00,x\no2,c2,shipped,2017-11-24 23:59:59,x\n"
    "o3,c3,canceled,2017-11-25 01:00:00,x\no4,c1,delivered,2017-11-26 01:00:00,x\n",
    "items": "order_id,order_item_id,product_id,price,freight_value\n"
    "o1,1,p1,10.10,1.005\no1,2,p2,20.20,2.00\no2,1,p1,5.00,1.00\no3,1,p1,7.00,1.00\n",
    "customers": "customer_id,customer_unique_id,customer_city,customer_state\nc1,u1,X,SP\nc2,u1,Y,RJ\n",
    "products": "product_id,product_category_name,product_weight_g\np1,toys,500\np2,,\np9,unsold,1\n",
}


@pytest.fixture(scope="module")
def csv_sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    paths = {}
    for name, text in CSV.items():
        path = folder / f"{name}.csv"
        path.write_text(text)
        paths[name] = str(path)
    return tables.from_csv(spark, paths)


def test_missing_inputs_are_named(spark):
    assert tables.missing_inputs({"orders": "x"}) == ["items", "customers", "products"]
    with pytest.raises(ValueError, match="items"):
        tables.from_csv(spark, {"orders": "x"})


def test_csv_to_facts(csv_sources):
    s = csv_sources
    rows = {r["order_id"]: r for r in star.build_fact_orders(s.orders, s.items, s.customers).collect()}
    assert set(rows) == {"o1", "o2"}  # o3 has a rejected status, o4 has no items
    assert float(rows["o1"]["order_value"]) == 30.30 and rows["o1"]["unique_products"] == 2
    assert rows["o1"]["customer_id"] == rows["o2"]["customer_id"] == "u1"


def test_customer_takes_the_first_city(csv_sources):
    s = csv_sources
    row = star.build_dim_customers(star.build_fact_orders(s.orders, s.items, s.customers)).first()
    assert (row["city"], row["state"], row["total_orders"], row["tier"]) == ("X", "SP", 2, "low_value")


def test_unsold_products_vanish(csv_sources):
    rows = {r["product_id"]: r for r in star.build_dim_products(csv_sources.items, csv_sources.products).collect()}
    assert set(rows) == {"p1", "p2"} and rows["p2"]["category"] is None


def test_labels_of_the_marketplace_calendar(spark, csv_sources):
    s = csv_sources
    daily = build_daily_kpis(star.build_fact_orders(s.orders, s.items, s.customers))
    calendar = marketplace_calendar(spark)
    assert calendar.count() == len(MARKETPLACE_EVENTS) == 18
    row = ground_truth(label_ground_truth(daily, calendar), calendar).first()
    assert (row["event_label"], row["anomaly_type"], row["severity"]) == ("Black Friday 2017", "spike", "high")


def test_holiday_rules(spark):
    rows = {(r["event_date"].year, r["label"].rsplit(" ", 1)[0]): r["event_date"] for r in holiday_calendar(spark, 1999, 2000).collect()}
    assert rows[1999, "Black Friday"] == dt.date(1999, 11, 26)
    assert rows[2000, "Mother's Day"] == dt.date(2000, 5, 14)


def test_zero_spend_has_no_tier(spark):
    spend = spark.createDataFrame([(0, "0"), (1, "10"), (2, "20"), (3, "1000")], "customer_id int, s string").select(
        "customer_id", F.col("s").cast("decimal(18,2)").alias("total_spent")
    )
    cuts = star.spend_quantiles(spend, (0.75, 0.95))
    tiers = {r["customer_id"]: r["tier"] for r in star.assign_tier(spend, cuts).collect()}
    assert tiers == {0: "nan", 1: "low_value", 2: "low_value", 3: "high_value"}


def test_global_rank_splits_a_hot_value(spark):
    """A third of the rows tie; ranks stay dense, running sums exact, and tiles as NTILE defines them."""
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("v")
    )
    got = rank_globally(df, [F.desc("v"), F.asc("id")], {"run": F.col("v")}).withColumn("tile", ntile(7)).toPandas()
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).reset_index(drop=True)
    got = got.sort_values("position").reset_index(drop=True)
    assert got["position"].tolist() == list(range(1, 3001)) and got["id"].tolist() == want["id"].tolist()
    assert got["run"].tolist() == want["v"].cumsum().tolist() and set(got["n_total"]) == {3000}
    sizes = got.groupby("tile").size().tolist()
    assert sizes == [429] * 4 + [428] * 3


def test_running_sums_with_negative_values_and_nulls(spark):
    """Refunds make running sums fall; a NULL adds nothing, and sums before the first value are NULL."""
    value = F.when(F.col("id") < 5, F.lit(None)).when(F.col("id") % 2 == 0, 5).otherwise(F.when(F.col("id") % 11 > 0, -7))
    df = spark.range(1000).select("id", value.cast("bigint").alias("v"))
    got = rank_globally(df, [F.asc("id")], {"run": F.col("v")}).orderBy("position").toPandas()
    values = df.orderBy("id").toPandas()["v"]
    assert got["run"].isna().tolist() == [i < 5 for i in range(1000)]
    assert got["run"].dropna().tolist() == values.fillna(0).cumsum()[5:].tolist()
    assert set(got["run_total"]) == {values.sum()}


def test_calendar_years_follow_the_data(spark):
    days = spark.createDataFrame([("2031-05-02",), ("2033-01-01",)], "d string").select(F.to_date("d").alias("d"))
    assert calendar_years(days, "d") == (2031, 2033)
    none = calendar_years(days.limit(0), "d")
    assert holiday_calendar(spark, *none).count() == 0


def test_intermediates_lie_in_the_shared_folder(spark):
    from revwatch.session import checkpoint_root, drop_path, materialize

    root = Path(checkpoint_root(spark)) / spark.sparkContext.applicationId
    table = materialize(spark.range(3).toDF("x"), "three")
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert folder.parent == root and table.count() == 3
    drop_path(spark, str(folder))
    assert not folder.exists()


def test_ntile_with_more_tiles_than_rows(spark):
    got = rank_globally(spark.range(3), [F.col("id")]).select(ntile(5).alias("t")).collect()
    assert sorted(r["t"] for r in got) == [1, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_pandas(spark, n):
    df = spark.range(n).select(((F.col("id") * 37) % 101).cast("double").alias("v"))
    row = exact_quantiles(df, "v", [0.25, 0.5, 0.99]).first()
    want = df.toPandas()["v"].quantile([0.25, 0.5, 0.99]).tolist()
    assert list(row) == pytest.approx(want)


def test_quantiles_per_key_match_pandas(spark):
    """One key holds most of the rows and spans several range partitions."""
    df = spark.range(2000).select(
        F.when(F.col("id") % 7 == 0, "small").otherwise("hot").alias("k"), ((F.col("id") * 37) % 701).cast("double").alias("v")
    )
    got = {r["k"]: (r["q25"], r["q50"]) for r in exact_quantiles_by(df, ["k"], "v", [0.25, 0.5]).collect()}
    want = df.toPandas().groupby("k")["v"].quantile([0.25, 0.5])
    assert got == {k: pytest.approx((want[k, 0.25], want[k, 0.5])) for k in ("hot", "small")}


def test_duplicate_rows_are_whole_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "c")], "x int, y string")
    got = {(r["x"], r["y"]): r["copies"] for r in quality.duplicate_rows(df).collect()}
    assert got == {(1, "a"): 2, (None, "c"): 3}


def test_partitioned_sink_and_csv_roundtrip(spark, warehouse, tmp_path):
    back = sinks.write_tables({"fact_orders": warehouse.fact_orders, "model_results": warehouse.model_results}, str(tmp_path))
    assert back["fact_orders"].count() == warehouse.fact_orders.count()
    assert any(p.name.startswith("month=") for p in (tmp_path / "fact_orders").iterdir())
    sinks.write_csv(warehouse.model_results, str(tmp_path / "results.csv"))
    again = sinks.read_model_results_csv(spark, str(tmp_path / "results.csv"))
    assert again.exceptAll(warehouse.model_results).count() == 0
    truth = ground_truth(warehouse.daily_kpis, warehouse.calendar)
    sinks.write_csv(truth, str(tmp_path / "truth.csv"))
    assert sinks.read_ground_truth_csv(spark, str(tmp_path / "truth.csv")).exceptAll(truth).count() == 0


def test_rca_report_is_writable(warehouse, tmp_path):
    written = sinks.write_tables(rca.rca_report(warehouse.model_results), str(tmp_path))
    assert len(written) == 7 and all(df.count() > 0 for df in written.values())


ROUTES = {
    "Which days had revenue anomalies?": "anomalies",
    "Compare model performance across all methods": "models",
    "Show total monthly revenue": "monthly",
    "Which product categories generate the most revenue?": "category",
    "Top 10 states by order count": "state",
    "What is the average anomaly detection rate by model type?": "anomalies",
    "Show me days where z-score exceeded 2.5": "state",
    "Which feature set works best?": "features",
    "z-score threshold": "zscore",
    "peak days": "top_days",
    "lowest days": "worst_days",
    "order status": "status",
    "": "empty",
    "   ": "empty",
    "random gibberish xyz": "overview",
    "'; DROP TABLE fact_orders; --": "overview",
}


def test_rule_order(spark):
    df = spark.createDataFrame([(q,) for q in ROUTES], "text string")
    got = {r["text"]: r["intent"] for r in df.select("text", questions.intent(F.col("text")).alias("intent")).collect()}
    assert got == ROUTES
    assert {q: questions.route(q) for q in ROUTES} == ROUTES


def test_answers(warehouse):
    w = warehouse
    tables_ = dict(
        fact=w.fact_orders, order_items=w.fact_order_items, products=w.sources.products, dim_customers=w.dim_customers,
        daily=w.daily_kpis, results=w.model_results,
    )
    assert questions.answer("", **tables_) is None
    for q, rule in ROUTES.items():
        if rule != "empty":
            assert questions.answer(q, **tables_).count() > 0
    assert w.fact_orders.count() > 0


def test_rules_find_violations(spark):
    fact = spark.createDataFrame([(1, -5.0), (1, 2.0), (2, 3.0)], "order_id int, order_value double")
    got = {r["check"]: r["violations"] for r in quality.dq_rules({"fact_orders": fact}, {"fact_orders": 10}).collect()}
    assert got == {"negative_order_value": 1, "duplicate_order_id": 1, "rows_missing_fact_orders": 7}


def test_category_null_group_rule(spark):
    """SQL reports keep a missing category as a group; the product tree leaves it out."""
    from revwatch.plans import business

    dim = spark.createDataFrame(
        [(1, "a", 10.0, 1.0), (2, None, 5.0, 1.0)],
        "product_id int, category string, total_revenue double, avg_price double",
    ).withColumn("total_revenue", F.col("total_revenue").cast("decimal(18,2)"))
    assert [r["category"] for r in business.category_tree(dim).collect()] == ["a"]
    items = spark.createDataFrame(
        [(1, 1, "delivered", 1000, 100), (2, 2, "delivered", 500, 100)],
        "order_id int, product_id int, order_status string, price_cents long, freight_cents long",
    )
    got = business.category_revenue(star.order_attribute_values(items, dim, F.col("category"))).toPandas()
    assert set(got["category"].where(pd.notna(got["category"]), None)) == {"a", None}


def test_bucketed_tables_join_without_a_shuffle(spark, warehouse, tmp_path, capsys):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}'")
    s = warehouse.sources
    sinks.save_as_tables({"orders": s.orders, "items": s.items}, "bucketed", {"orders": "order_id", "items": "order_id"}, 8)
    assert {"items", "orders"} <= set(sinks.list_tables(spark, "bucketed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders, items = spark.table("bucketed.orders"), spark.table("bucketed.items")
        joined = orders.join(items.groupBy("order_id").agg(F.sum("price_cents").alias("value")), "order_id")
        joined.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert joined.count() == warehouse.fact_orders_all.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_status_filter_reaches_the_scan(spark, sf_dir, capsys):
    star.valid_orders(tables.from_wholesale(spark, sf_dir, star.VALID_STATUSES).orders).explain()
    assert "PushedFilters: [In(o_orderstatus, [F,O])]" in capsys.readouterr().out


def test_sketch_options_are_close(warehouse):
    exact = build_daily_kpis(warehouse.fact_orders).orderBy("order_date").collect()
    sketch = build_daily_kpis(warehouse.fact_orders, approx_customers=True).orderBy("order_date").collect()
    gaps = [abs(a["unique_customers"] - b["unique_customers"]) for a, b in zip(exact, sketch)]
    assert max(gaps) <= 1
    spend = star.customer_spend(warehouse.fact_orders)
    near, at = star.spend_quantiles(spend, (0.75,), 10_000).first()["q75"], star.spend_quantiles(spend, (0.75,)).first()["q75"]
    assert near == pytest.approx(at, rel=0.05)


def test_workers_need_no_copy_of_the_package(sf_dir, tmp_path):
    """Functions travel with their code: a session started elsewhere finds them."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from revwatch.session import build_session\n"
        "spark = build_session(master='local[2]', **{'spark.sql.shuffle.partitions': '2'})\n"
        "import __spark_entry__ as c\n"
        f"assert c.queries()['grid_stl'](spark, {sf_dir!r}).count() == 75\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, capture_output=True)


def test_a_scope_drops_what_was_written_on_the_way(spark, sf_dir):
    """Only the shared table itself is left after it was built; a query in a scope leaves nothing."""
    from revwatch.plans.warehouse import Warehouse
    from revwatch.session import checkpoint_root, intermediates

    house = Warehouse(spark, sf_dir)
    _ = house.fact_orders_all
    root = Path(checkpoint_root(spark)) / spark.sparkContext.applicationId
    count = lambda: sum(1 for _ in root.iterdir())
    start = count()
    _ = house.dim_customers
    assert count() == start + 1
    with intermediates(spark):
        rank_globally(spark.range(50), [F.col("id")]).count()
    assert count() == start + 1


def test_scopes_of_equal_contents_are_kept_apart(spark):
    """An inner scope that ends while both are empty leaves the outer one open, which still drops what is its own."""
    from revwatch.session import checkpoint_root, intermediates, materialize

    (spark_root := Path(checkpoint_root(spark)) / spark.sparkContext.applicationId).mkdir(parents=True, exist_ok=True)
    before = set(spark_root.iterdir())
    with intermediates(spark):
        with intermediates(spark):
            pass
        assert materialize(spark.range(3), "outer").count() == 3
    assert set(spark_root.iterdir()) == before


def test_a_shared_table_may_build_the_ones_below_it(spark, sf_dir):
    """Shared tables that build others on the way are written whatever stands already."""
    from revwatch.plans.warehouse import Warehouse

    assert Warehouse(spark, sf_dir).dim_customers.count() > 0


def test_items_are_dealt_before_they_are_held(spark, capsys):
    """No hash table over a split of the items, whose size would follow the file; the sums are those of the rows."""
    rows = [(1, 1, 7, 100, 5), (1, 2, 7, 200, 6), (1, 3, 8, 300, 7), (2, 1, 7, 50, 1), (None, 1, 9, 10, 2)]
    items = spark.createDataFrame(
        rows, "order_id bigint, order_item_id int, product_id bigint, price_cents bigint, freight_cents bigint"
    )
    totals = star.order_totals(items)
    totals.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.rindex("Exchange hashpartitioning") :]
    got = {r[0]: (float(r[1]), float(r[2]), r[3], r[4]) for r in totals.collect()}
    assert got == {1: (6.0, 0.18, 3, 2), 2: (0.5, 0.01, 1, 1), None: (0.1, 0.02, 1, 1)}
