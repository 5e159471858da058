"""Every registered query against its SQL, and invariants of the ones without SQL."""

import __spark_entry__ as contract
import pytest
from compare import compare, connect
from revwatch.oracle.base import CTES, query
from revwatch.oracle.queries import SQL

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
# Expensive parts of the SQL that many queries share; the tests compute them once per data set.
SHARED = ("forest_scores", "lof_scores", "results")


@pytest.fixture(scope="module")
def con(sf_dir):
    con = connect(sf_dir)
    for k, name in enumerate(SHARED):
        con.execute(f"CREATE TABLE {name} AS {query(f'SELECT * FROM {name}', frozenset(SHARED[:k]))}")
    assert all(name in CTES for name in SHARED)
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, con):
    sql = query(SQL[name], frozenset(SHARED)) if name in SQL else ORACLE[name]
    assert compare(QUERIES[name](spark, sf_dir), con, sql) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join(name, spark, sf_dir, capsys):
    QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, sf_dir):
    df = contract.entry(spark)
    assert df.columns == ["order_date", "daily_revenue", "order_count", "z_score", "anomaly_type"]


def test_full_grid(warehouse):
    rows = {r["method_type"]: r for r in warehouse.model_results_all.groupBy("method_type").count().collect()}
    assert {m: r["count"] for m, r in rows.items()} == {
        "IsolationForest": 1155, "LocalOutlierFactor": 343, "DBSCAN": 490, "ZScore": 54, "RollingZScore": 105,
        "STL_Residual": 75, "EWM_ZScore": 105,
    }


def test_default_grid_leaves_no_family_out(warehouse):
    rows = {r["method_type"]: r["count"] for r in warehouse.model_results.groupBy("method_type").count().collect()}
    assert rows == {
        "IsolationForest": 1155, "LocalOutlierFactor": 343, "DBSCAN": 490, "ZScore": 54, "RollingZScore": 105,
        "SeasonalResidual": 75, "EWM_ZScore": 105, "IQR": 24, "MAD": 18,
    }


def test_contamination_is_respected(warehouse):
    """A contamination cut flags about its share of the days."""
    rows = warehouse.model_results_all.filter("method_type = 'IsolationForest'").collect()
    assert all(abs(r["anomaly_pct"] - 100 * r["contamination"]) < 1.0 for r in rows)


def test_contract_holds(spark, sf_dir):
    from revwatch.sources.contract import contract_violations

    assert contract_violations(spark, sf_dir).count() == 0
    broken = {"orders": {"o_orderkey": "string", "absent": "int"}}
    assert contract_violations(spark, sf_dir, broken).count() == 2
