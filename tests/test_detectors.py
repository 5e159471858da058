"""Detectors against pandas, brute force and planted spikes."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from revwatch.operators import features as feat
from revwatch.operators import grid
from revwatch.operators.detectors import blocks, density, isolation, pointwise, sequential
from revwatch.operators.kpis import build_daily_kpis, label_ground_truth

START = dt.date(2020, 1, 1)
ONE = ["daily_revenue"]


def series(spark, values, key=None):
    """A feature frame whose daily revenue is ``values``."""
    rows = [
        (*([key] if key else []), START + dt.timedelta(days=i), int(v > 900), float(v), float(i % 7), float(v) / 7, 3.0)
        for i, v in enumerate(values)
    ]
    names = [*(["state"] if key else []), "order_date", "is_true_anomaly", *feat.BASE_FEATURES]
    return spark.createDataFrame(rows, names).withColumn("order_date", F.col("order_date").cast("date"))


def noisy(n=400, seed=3):
    rng = np.random.default_rng(seed)
    values = 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 3, n)
    values[n // 2] += 200
    return np.round(values, 2)


def collect(df, name="score", *extra):
    rows = df.orderBy("order_date").select(*extra, name).collect()
    return np.array([r[name] for r in rows], float)


def test_rolling_matches_pandas(spark):
    x = pd.Series(noisy())
    ours = collect(pointwise.rolling_scores(series(spark, x), (), ONE, [7]))
    z = (x - x.rolling(7, min_periods=1).mean()) / x.rolling(7, min_periods=1).std().fillna(1)
    np.testing.assert_allclose(ours, z.fillna(0).abs(), atol=1e-7)


def test_ewm_matches_pandas_across_slabs(spark, monkeypatch):
    monkeypatch.setattr(sequential, "SLAB_DAYS", 64)
    x = pd.Series(noisy(500))
    ours = collect(sequential.ewm_scores(series(spark, x), (), ONE, [5]))
    z = (x - x.ewm(span=5).mean()) / x.ewm(span=5).std().fillna(1)
    np.testing.assert_allclose(ours, z.fillna(0).abs(), atol=1e-8)


@pytest.mark.parametrize("window", [5, 7, 10, 14])
def test_rolling_is_bounded_by_its_window(spark, window):
    """A value inside its own window cannot exceed (w - 1) / sqrt(w)."""
    ours = collect(pointwise.rolling_scores(series(spark, noisy()), (), ONE, [window]))
    assert ours.max() <= (window - 1) / math.sqrt(window) + 1e-6


def planted():
    values = [100.0 + (i % 5) for i in range(90)]
    values[45] = 1000.0
    return values


@pytest.mark.parametrize(
    "scores",
    [
        lambda f: pointwise.zscore_scores(f, (), ONE),
        lambda f: pointwise.iqr_scores(f, (), ONE),
        lambda f: pointwise.mad_scores(f, (), ONE),
        lambda f: pointwise.rolling_scores(f, (), ONE, [30]),
        lambda f: sequential.ewm_scores(f, (), ONE, [30]),
        lambda f: sequential.seasonal_scores(f, (), ONE, [7]),
        lambda f: sequential.stl_scores(f, (), ONE, [7]),
        lambda f: density.lof_scores(feat.feature_vectors(f, (), {"one": ONE}), (), [10]),
        lambda f: isolation.isolation_scores(feat.feature_vectors(f, (), {"one": ONE}), (), [1.0], [100]),
    ],
    ids=["z", "iqr", "mad", "rolling", "ewm", "seasonal", "stl", "lof", "iforest"],
)
def test_planted_spike_ranks_first(spark, scores):
    ours = collect(scores(series(spark, planted())))
    assert ours.argmax() == 45


def test_constant_series_has_no_scores(spark):
    flat = series(spark, [50.0] * 20)
    assert collect(pointwise.rolling_scores(flat, (), ONE, [7])).max() == 0
    assert collect(sequential.ewm_scores(flat, (), ONE, [7])).max() == 0
    row = grid.grid_zscore(feat.build_features(flat)).filter("feature_set = 'daily_revenue'").agg(F.max("anomalies_detected")).first()
    assert row[0] == 0


def test_single_day(spark):
    one = series(spark, [50.0])
    assert collect(pointwise.rolling_scores(one, (), ONE, [7])).tolist() == [0.0]
    assert collect(sequential.ewm_scores(one, (), ONE, [7])).tolist() == [0.0]


def test_series_do_not_mix(spark):
    """Scores of one series are the same alone and next to another one."""
    a, b = series(spark, noisy(), "A"), series(spark, noisy(300, 9) * 50, "B")
    alone = collect(pointwise.zscore_scores(series(spark, noisy()), (), ONE))
    both = pointwise.zscore_scores(a.unionByName(b), ["state"], ONE).filter("state = 'A'")
    np.testing.assert_allclose(collect(both), alone, atol=1e-12)
    vectors = feat.feature_vectors(a.unionByName(b), ["state"], {"one": ONE})
    lof = density.lof_scores(vectors, ["state"], [10]).filter("state = 'A'")
    alone = density.lof_scores(feat.feature_vectors(series(spark, noisy()), (), {"one": ONE}), (), [10])
    np.testing.assert_allclose(collect(lof), collect(alone), atol=1e-12)


# --- density detectors against brute force, with blocks far smaller than the series ---

SETS = {"one": ONE, "four": list(feat.BASE_FEATURES[:3]) + ["revenue_diff"]}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 40)


@pytest.fixture(scope="module")
def vectors(spark):
    frame = feat.build_features(series(spark, noisy(300)))
    return feat.feature_vectors(frame, (), SETS)


def matrix(vectors, name):
    rows = vectors.filter(F.col("feature_set") == name).orderBy("order_date").collect()
    x = np.array([r["vec"] for r in rows])
    return np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)


@pytest.mark.parametrize("name", SETS)
def test_lof_matches_brute_force(vectors, small_blocks, name):
    k = 12
    d = matrix(vectors, name)
    np.fill_diagonal(d, np.inf)
    nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
    k_dist = np.take_along_axis(d, nearest[:, -1:], 1)[:, 0]
    reach = np.maximum(np.take_along_axis(d, nearest, 1), k_dist[nearest])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    expected = (lrd[nearest] / lrd[:, None]).mean(axis=1)
    ours = density.lof_scores(vectors, (), [5, k]).filter(
        (F.col("feature_set") == name) & (F.col("n_neighbors") == k)
    )
    np.testing.assert_allclose(collect(ours), expected, rtol=1e-9)


@pytest.mark.parametrize("name", SETS)
def test_dbscan_noise_matches_brute_force(vectors, small_blocks, name):
    d = matrix(vectors, name)
    reach = density.best_reachable_density(vectors, (), [0.3, 1.0]).filter(F.col("feature_set") == name)
    for eps in (0.3, 1.0):
        near = d <= eps
        counts = near.sum(axis=1)
        ours = collect(reach.filter(F.col("eps") == eps), "density")
        for m in (2, 5, 20):
            noise = ~(near & (counts >= m)[None, :]).any(axis=1)
            assert (ours < m).tolist() == noise.tolist()


def test_blocks_stay_small_under_a_hot_value(spark, small_blocks):
    """A third of the days share one vector; the cuts still bound every block."""
    values = [100.0] * 200 + list(noisy(400))
    frame = feat.feature_vectors(series(spark, values), (), {"one": ONE})
    sizes = [r["n"] for r in blocks.to_blocks(frame, ["feature_set"], 1).select(F.size("days").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 40


def test_isolation_forest_is_stable_and_split_independent(spark, monkeypatch):
    v = feat.feature_vectors(series(spark, noisy(300)), (), {"one": ONE})
    whole = collect(isolation.isolation_scores(v, (), [1.0], [50]))
    monkeypatch.setattr(isolation, "POINTS_PER_GROUP", 100)
    np.testing.assert_allclose(collect(isolation.isolation_scores(v, (), [1.0], [50])), whole, atol=1e-12)
    assert 0 < whole.min() and whole.max() < 1


def test_forest_draws_are_alike_in_arrays_and_columns(spark):
    numbers = [0, 1, 7, 2**31 - 2, 123456789]
    frame = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(isolation.spread(F.col("n")).alias("s"))
    assert [r["s"] for r in frame.collect()] == isolation.spread(np.array(numbers)).tolist()
    assert len(np.unique(isolation.spread(np.arange(10_000)))) > 9_990


def test_average_path_length():
    """c(n) = 2 H(n - 1) - 2 (n - 1) / n, with c(1) = 0 and c(2) = 1."""
    assert isolation.average_path(np.array([0, 1, 2])).tolist() == [0, 0, 1]
    assert isolation.average_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


def test_stl_separates_season_and_trend():
    t = np.arange(210)
    y = 0.5 * t + 20 * np.sin(2 * np.pi * t / 7)
    resid = sequential.stl_residual(y, 7)
    assert np.abs(resid).max() < 0.5
    y[100] += 50
    spiked = sequential.stl_residual(y, 7)
    assert np.abs(spiked).argmax() == 100 and spiked[100] > 40


def test_gap_days_are_row_based(spark):
    """A missing day does not stretch the window: frames count rows."""
    frame = series(spark, range(1, 11)).filter("order_date <> date'2020-01-05'")
    got = feat.build_features(frame).orderBy("order_date").collect()
    values = pd.Series([1, 2, 3, 4, 6, 7, 8, 9, 10.0])
    expected = values.rolling(7, min_periods=1).mean().tolist()
    assert [r["revenue_ma7"] for r in got] == pytest.approx(expected)


def test_spike_has_z_above_two(spark):
    values = [100, 102, 98, 101, 99, 500, 97, 103, 100, 101]
    scaled = feat.scale_standard(series(spark, values), ONE).orderBy("order_date").collect()
    assert scaled[5]["daily_revenue"] > 2


def test_extreme_days_become_labels(spark):
    fact = spark.createDataFrame(
        [(i, i % 3, START + dt.timedelta(days=i), 1000.0 if i == 45 else 100.0 + i % 5, 1.0) for i in range(90)],
        "order_id long, customer_id long, order_date date, order_value double, freight_value double",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("order_value", "freight_value")})
    calendar = spark.createDataFrame(
        [(START, "drop", "high", "New Year")], "event_date date, type string, severity string, label string"
    )
    rows = label_ground_truth(build_daily_kpis(fact), calendar).filter("is_true_anomaly = 1").orderBy("order_date").collect()
    assert [r["event_label"] for r in rows] == ["New Year", "Extreme statistical outlier"]
