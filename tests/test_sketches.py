"""Mergeable sketches and bags of little bootstraps."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from revwatch.operators import hypothesis, sketches


@pytest.fixture(scope="module")
def rows(spark):
    """30,000 values over 40 days, one day holding a third of them, with ties and nulls."""
    rng = np.random.default_rng(8)
    days = np.where(rng.random(30_000) < 0.33, 7, rng.integers(0, 40, 30_000))
    values = np.round(rng.lognormal(3, 1, 30_000), 1)
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=int(d)), float(v), int(u)) for d, v, u in zip(days, values, rng.integers(0, 9_000, 30_000), strict=True)]
    data += [(dt.date(2024, 1, 3), None, None)] * 5
    return data, spark.createDataFrame(data, "order_date date, value double, user bigint")


def test_merged_quantiles_keep_their_rank(rows):
    data, frame = rows
    daily = sketches.quantile_sketches(frame, ["order_date"], "value", 200)
    month = F.date_format("order_date", "yyyy-MM").alias("month")
    merged = sketches.merged_quantiles(daily, [month], 200)
    asked = sketches.read_quantiles(merged, ["month"], [0.0, 0.01, 0.5, 0.99, 1.0])
    assert {r.month: r.n for r in merged.collect()} == {
        m: sum(d.strftime("%Y-%m") == m and v is not None for d, v, _ in data) for m in ("2024-01", "2024-02")
    }
    misses = sketches.rank_misses(frame.withColumn("month", month), ["month"], "value", asked).collect()
    assert len(misses) == 10 and all(r.miss <= 2 * sketches.rank_error(200) for r in misses)
    exact = {m: sorted(v for d, v, _ in data if v is not None and d.strftime("%Y-%m") == m) for m in ("2024-01", "2024-02")}
    ends = {(r.month, r.rank): r.estimate for r in asked.collect()}
    assert all(ends[m, 0.0] == v[0] and ends[m, 1.0] == v[-1] for m, v in exact.items())


def test_small_sketches_are_exact(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", None)], "k string, v double")
    sketched = sketches.quantile_sketches(frame, ["k"], "v")
    assert [(r.k, r.estimate) for r in sketches.read_quantiles(sketched, ["k"], [0.5]).collect()] == [("a", 50.0)]
    assert sketches.quantile_sketches(frame.limit(0), ["k"], "v").collect() == []


def test_merged_distinct_counts(rows):
    data, frame = rows
    daily = sketches.distinct_sketches(frame, ["order_date"], "user")
    for key, of in (("yyyy-MM", "%Y-%m"), ("yyyy", "%Y")):
        merged = sketches.merged_distinct(daily, [F.date_format("order_date", key).alias("period")])
        for r in merged.collect():
            exact = len({u for d, _, u in data if u is not None and d.strftime(of) == r.period})
            assert abs(r.estimate - exact) <= 4 * sketches.distinct_error() * exact


def test_little_bootstraps_cover(spark):
    """Intervals about as wide as the theory says, around the value of all rows."""
    rng = np.random.default_rng(5)
    data = [("a", k, float(v)) for k, v in enumerate(rng.normal(50, 10, 4_000))] + [("b", k, 1.0) for k in range(40)] + [("c", 1, 5.0)]
    frame = spark.createDataFrame(data, "g string, id bigint, x double")
    got = {(r.g, r.statistic): r for r in hypothesis.little_bootstraps_ci(frame, ["g"], "x", ["id"]).collect()}
    assert {g for g, _ in got} == {"a", "b"}
    x = np.array([v for g, _, v in data if g == "a"])
    mean, median = got["a", "mean"], got["a", "median"]
    assert mean.n == 4000 and mean.estimate == pytest.approx(x.mean()) and median.estimate == pytest.approx(np.median(x))
    width = 2 * 1.96 * x.std() / 4000**0.5
    assert 0.7 * width < mean.ci_upper - mean.ci_lower < 1.4 * width
    assert 0.7 * 1.2533 * width < median.ci_upper - median.ci_lower < 1.6 * 1.2533 * width
    assert (got["b", "mean"].ci_lower, got["b", "median"].ci_upper) == (1.0, 1.0)


def test_little_bootstraps_shuffle_does_not_grow(spark, capsys):
    frame = spark.range(1000).selectExpr("id % 3 AS g", "id", "rand(1) AS x")
    plans = []
    for replicates in (5, 500):
        hypothesis.little_bootstraps_ci(frame, ["g"], "x", ["id"], replicates=replicates).explain()
        plans.append(capsys.readouterr().out)
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    # The rows are dealt out by group and subset below the point where they meet the replicates, and not again above it.
    at = plans[1].index("sequence(0, 499)") if "sequence(0, 499)" in plans[1] else plans[1].index("Generate")
    below = plans[1][at:]
    assert below.index("Exchange") == below.index("Exchange hashpartitioning(g")
    above = plans[1][:at]
    resampling = above[above.rindex("partial_") :]
    assert "Exchange" not in resampling
