"""Confusion metrics, sweeps and curves on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from revwatch.operators import evaluate

SCHEMA = "is_true_anomaly int, pred int"


def metrics(spark, truth, pred):
    df = spark.createDataFrame(list(zip(truth, pred)), SCHEMA)
    return evaluate.evaluate_detector(df, "is_true_anomaly", "pred", method="m").first().asDict()


def test_perfect_detector(spark):
    flags = [0, 0, 0, 1, 1, 0, 0, 1, 0, 0]
    m = metrics(spark, flags, flags)
    assert (m["precision"], m["recall"], m["f1_score"], m["false_positives"]) == (1, 1, 1, 0)


def test_never_flags(spark):
    m = metrics(spark, [0, 0, 1, 1, 0], [0] * 5)
    assert (m["recall"], m["false_negatives"], m["precision"]) == (0, 2, 0)


def test_flags_all(spark):
    m = metrics(spark, [0, 0, 0, 0, 1], [1] * 5)
    assert (m["recall"], m["precision"], m["false_positives"], m["specificity"]) == (1, 0.2, 4, 0)


def test_twelve_fields(spark):
    assert len(metrics(spark, [0, 1, 0, 1], [0, 1, 1, 0])) == 12


def test_cells_sum_to_rows(spark):
    truth, pred = [i * 7 % 3 == 0 for i in range(100)], [i * 5 % 4 == 0 for i in range(100)]
    m = metrics(spark, [int(t) for t in truth], [int(p) for p in pred])
    assert sum(m[f"{k}s"] for k in ("true_positive", "false_positive", "true_negative", "false_negative")) == 100


def days(spark):
    rows = [
        (dt.date(2024, 1, 1) + dt.timedelta(days=i), int(i >= 350), int(i >= 355), int(i >= 352), ((i * 37) % 100 - 50) / 12)
        for i in range(365)
    ]
    return spark.createDataFrame(rows, "order_date date, is_true_anomaly int, a int, b int, z_score double")


def test_methods_are_sorted_and_absent_ones_skipped(spark):
    rows = evaluate.evaluate_all(days(spark), {"A": "a", "B": "b", "C": "c"}).collect()
    assert [r["method"] for r in rows] == ["B", "A"]
    assert rows[0]["f1_score"] >= rows[1]["f1_score"]


def test_sweep_flags_fewer_at_higher_thresholds(spark):
    rows = evaluate.threshold_sweep(days(spark)).orderBy("threshold").collect()
    flagged = [r["total_flagged"] for r in rows]
    assert len(rows) == 13 and flagged == sorted(flagged, reverse=True)


def test_best_threshold_prefers_the_first(spark):
    sweep = spark.createDataFrame([(1.0, 0.5), (1.25, 0.7), (1.5, 0.7)], "threshold double, f1_score double")
    assert evaluate.best_threshold(sweep).first()["threshold"] == 1.25


def scores(spark, rows):
    df = spark.createDataFrame(rows, "score double, is_true_anomaly int")
    return df.withColumn("method", F.lit("m"))


def test_auc_of_a_perfect_ranking(spark):
    df = scores(spark, [(4.0, 1), (3.0, 1), (2.0, 0), (1.0, 0)])
    assert evaluate.roc_auc(df).first()["roc_auc"] == 1.0
    assert evaluate.pr_auc(df).first()["pr_auc"] == 1.0


def test_ties_make_one_point(spark):
    df = scores(spark, [(1.0, 1), (1.0, 0), (1.0, 1), (1.0, 0)])
    assert evaluate.roc_curve(df).count() == 2
    assert evaluate.roc_auc(df).first()["roc_auc"] == 0.5


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_no_area(spark, label):
    df = scores(spark, [(2.0, label), (1.0, label)])
    assert evaluate.roc_auc(df).first()["roc_auc"] is None
