"""Rate classes, root-cause tables and hypothesis tests on literal frames."""

import math

import pytest
from pyspark.sql import functions as F
from revwatch.functions import pvalues
from revwatch.functions.labels import param, rate_class
from revwatch.operators import hypothesis, rca

RATES = [
    (0.0, "too_conservative"), (0.5, "too_conservative"), (1.0, "conservative"), (2.9, "conservative"),
    (3.0, "reasonable"), (5.0, "reasonable"), (10.0, "reasonable"), (10.01, "aggressive"), (11.0, "aggressive"),
    (20.0, "aggressive"), (20.01, "broken"), (21.0, "broken"), (80.0, "broken"), (100.0, "broken"),
]


def test_rate_class_boundaries(spark):
    df = spark.createDataFrame(RATES, "pct double, expected string")
    assert df.filter(rate_class(F.col("pct")) != F.col("expected")).count() == 0


METHODS = {"IsolationForest": (2, 8), "DBSCAN": (0, 80), "LocalOutlierFactor": (1, 25), "ZScore": (3, 7)}


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for method, (low, high) in METHODS.items():
        for i in range(50):
            pct = round(low + (high - low) * i / 49, 1)
            name = f"DBSCAN_eps{0.5 + i % 3}_ms{i}" if method == "DBSCAN" else f"{method}_c0.0{1 + i % 5}"
            rows.append((name, method, pct, ["a", "b", "c"][i % 3], "standard", [2, 5, 21][i % 3]))
    return spark.createDataFrame(
        rows, "model string, method_type string, anomaly_pct double, feature_set string, scaler string, n_features int"
    )


def test_method_table(results):
    rows = {r["method_type"]: r for r in rca.method_performance(results).collect()}
    assert set(rows) == set(METHODS)
    assert all(0 <= r["success_rate_pct"] <= 100 for r in rows.values())
    assert rows["IsolationForest"]["success_rate_pct"] > rows["DBSCAN"]["success_rate_pct"]


def test_feature_table(results):
    rows = rca.feature_set_impact(results).collect()
    assert len(rows) == 3 and all(0 <= r["reasonable_pct"] <= 100 for r in rows)
    assert {r["n_features_used"] for r in rows} == {2, 5, 21}


def test_params_come_from_names(spark):
    row = spark.createDataFrame([("DBSCAN_eps0.5_ms3",), ("Z",)], "model string").select(
        param("model", r"eps([\d.]+)").alias("eps"), param("model", r"ms(\d+)").alias("ms")
    ).collect()
    assert tuple(row[0]) == (0.5, 3.0) and tuple(row[1]) == (None, None)


def test_dbscan_table_reads_eps(results):
    assert {r["eps"] for r in rca.dbscan_sensitivity(results).select("eps").distinct().collect()} == {0.5, 1.5, 2.5}


def test_best_keeps_three_per_method(results):
    counts = rca.best_configurations(results).groupBy("method_type").count().collect()
    assert all(r["count"] <= 3 for r in counts)


# --- p-values: published table values ---


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (2.576, 1e6, 0.01), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert pvalues.t_two_sided(t, df) == pytest.approx(p, abs=5e-4)


@pytest.mark.parametrize("x, df, p", [(3.841, 1, 0.05), (18.307, 10, 0.05), (6.635, 1, 0.01), (0.0, 3, 1.0)])
def test_chi2_tail(x, df, p):
    assert pvalues.chi2_upper(x, df) == pytest.approx(p, abs=5e-5)


def test_normal_tail():
    assert pvalues.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_paired_test_needs_five_pairs(results):
    flagged = results.withColumn("ok", F.col("anomaly_pct").between(3, 10).cast("int"))
    row = hypothesis.paired_ttest(flagged, "ok", "feature_set", ["a"], ["b", "c"]).first()
    assert row["n_pairs"] == 4 and row["t"] is None and row["p_value"] is None


def test_chi_square_two_by_two_is_corrected(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 25 + [("b", 0)] * 5
    out = hypothesis.chi_square(spark.createDataFrame(rows, "g string, ok int"), "g", F.col("ok") == 1).first()
    # n (|ad - bc| - n/2)² / (row and column totals)
    expected = 60 * (abs(10 * 5 - 20 * 25) - 30) ** 2 / (30 * 30 * 35 * 25)
    assert out["chi2"] == pytest.approx(expected) and out["dof"] == 1


def test_mann_whitney_counts_wins(spark):
    a, b = [1.0, 4.0, 4.0, 7.0], [2.0, 4.0, 6.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b]
    out = hypothesis.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    wins = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert out["u"] == wins and out["median_a"] == 4.0 and 0 < out["p_value"] <= 1


def test_bootstrap_skips_small_groups_and_brackets_the_mean(spark):
    rows = [("big", i, float(i % 2)) for i in range(200)] + [("small", i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    for out in (
        hypothesis.bootstrap_ci(df, ["g"], "x", ["id"], replicates=500).collect(),
        hypothesis.poisson_bootstrap_ci(df, ["g"], "x", ["id"], replicates=500).collect(),
    ):
        assert [r["g"] for r in out] == ["big"]
        half = 1.96 * math.sqrt(0.25 / 200)
        assert out[0]["ci_lower"] == pytest.approx(0.5 - half, abs=0.03)
        assert out[0]["ci_upper"] == pytest.approx(0.5 + half, abs=0.03)


def test_bootstrap_takes_any_aggregate(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(50)], "g string, id int, x double")
    row = hypothesis.bootstrap_ci(df, ["g"], "x", ["id"], statistic=F.median, replicates=200).first()
    assert row["estimate"] == 24.5 and row["ci_lower"] < 24.5 < row["ci_upper"]
