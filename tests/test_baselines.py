"""Baselines with a validity, alerts as of a row's own day, and ordered state over late days."""

import datetime as dt
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F
from revwatch.operators import baselines
from revwatch.streaming import kpis as streaming
from revwatch.streaming import monitor, ordered

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "series string, order_date date, value double"


def day(k):
    return DAY0 + dt.timedelta(days=k)


def series(values, name="a", first=0):
    return [(name, day(first + k), v) for k, v in enumerate(values)]


def moments(rows):
    return baselines.daily_moments(rows, "value", ["series"])


def test_versions_see_only_the_days_before(spark):
    values = [float(10 + (7 * k) % 13) for k in range(130)]
    frame = spark.createDataFrame(series(values) + series(values[:5], "b"), SCHEMA)
    got = baselines.baseline_versions(moments(frame), ["series"], days=30, every="day").collect()
    by_day = {r.valid_from: r for r in got if r.series == "a"}
    assert min(by_day) == day(2) and max(by_day) == day(130)
    for k in range(2, 131):
        before = values[max(k - 30, 0) : k]
        r = by_day[day(k)]
        assert r.base_rows == len(before)
        assert r.base_mean == pytest.approx(statistics.mean(before))
        assert r.base_std == pytest.approx(statistics.stdev(before))
        assert r.valid_to == (day(k + 1) if k < 130 else day(160))
    assert {r.valid_from for r in got if r.series == "b"} == {day(k) for k in range(2, 6)}


def test_versions_of_months(spark):
    frame = spark.createDataFrame(series([1.0, 2.0] * 40), SCHEMA)
    got = baselines.baseline_versions(moments(frame), ["series"]).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.base_rows) for r in got] == [
        (dt.date(2024, 2, 1), dt.date(2024, 3, 1), 31),
        (dt.date(2024, 3, 1), dt.date(2024, 5, 30), 60),
    ]
    empty = baselines.baseline_versions(moments(spark.createDataFrame([], SCHEMA)), ["series"])
    assert empty.collect() == []


def test_versions_of_large_amounts(spark):
    """Squares of days of a hundred million and more, whose cents squared pass 64 bits, are still exact."""
    values = [1e8 + 1e7 * ((7 * k) % 13) for k in range(40)] + [2.5e13]
    frame = spark.createDataFrame(series(values), SCHEMA)
    got = baselines.baseline_versions(moments(frame), ["series"], days=30, every="day").collect()
    assert len(got) == 40
    for r in got:
        k = (r.valid_from - DAY0).days
        before = values[max(k - 30, 0) : k]
        assert r.base_mean == pytest.approx(statistics.mean(before), rel=1e-12)
        assert r.base_std == pytest.approx(statistics.stdev(before), rel=1e-12)


def alerts(spark, rows, every="day"):
    frame = spark.createDataFrame(rows, SCHEMA)
    versions = baselines.baseline_versions(moments(frame), ["series"], every=every)
    found = baselines.alerts_as_of(frame, versions, ["series"], "value", F.col("order_date"))
    return {(r.series, r.order_date, r.alert, r.valid_from, r.z_score) for r in found.collect()}


def test_a_later_row_changes_no_earlier_alert(spark):
    rows = series([10.0, 11.0] * 20 + [40.0] + [10.0, 11.0] * 5)
    before = alerts(spark, rows)
    assert {(r[1], r[2]) for r in before} == {(day(40), "SPIKE")}
    later = rows + series([900.0, 0.0, 900.0], first=60)
    for every in ("day", "month"):
        assert {r for r in alerts(spark, later, every) if r[1] < day(60)} == alerts(spark, rows, every)


def test_rows_between_two_versions_and_after_the_last(spark):
    versions = spark.createDataFrame(
        [("a", day(0), day(40), 5, 10.0, 1.0), ("a", day(40), day(50), 5, 100.0, 1.0)],
        "series string, valid_from date, valid_to date, base_rows bigint, base_mean double, base_std double",
    )
    rows = spark.createDataFrame([("a", day(k), 100.0) for k in (0, 39, 40, 49, 50)] + [("b", day(1), 1.0), ("a", None, 1.0)], SCHEMA)
    met = baselines.as_of(rows, versions, ["series"], F.col("order_date")).collect()
    assert {(r.order_date, r.base_mean) for r in met} == {(day(0), 10.0), (day(39), 10.0), (day(40), 100.0), (day(49), 100.0)}
    assert len(met) == 4


def test_refreshes_add_versions_and_keep_the_old_ones(spark, tmp_path):
    store = baselines.VersionStore(spark, str(tmp_path / "store"), ["series"])
    assert store.read() is None
    first = spark.createDataFrame(series([10.0, 11.0] * 10), SCHEMA)
    old = {r.valid_from: r for r in store.refresh(moments(first), every="day").collect()}
    corrected = series([99.0, 11.0] * 10) + series([10.0] * 5, first=20) + series([1.0, 2.0, 3.0], "b", 3)
    new = [r for r in store.refresh(moments(spark.createDataFrame(corrected, SCHEMA)), every="day").collect()]
    mine = {r.valid_from: r for r in new if r.series == "a"}
    assert set(mine) == {day(k) for k in range(2, 26)} and any(r.series == "b" for r in new)
    assert all(mine[d].base_mean == old[d].base_mean for d in old)
    assert mine[max(old)].valid_to == max(old) + dt.timedelta(days=1) and mine[day(25)].valid_to == day(115)


def test_a_stream_meets_the_versions_stored_by_then(spark, tmp_path):
    folder, root = str(tmp_path / "events"), str(tmp_path / "out")
    store = baselines.VersionStore(spark, str(tmp_path / "store"), ["series"])

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def judged():
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        found = monitor.drain_alerts(events, store.read, ["series"], "value", F.col("order_date"), root=root)
        return sorted((r.order_date, r.valid_from) for r in found.collect())

    past = series([10.0, 11.0] * 10)
    store.refresh(moments(spark.createDataFrame(past, SCHEMA)), every="day")
    feed([("a", day(20), 30.0), ("a", day(5), 30.0)])
    assert judged() == [(day(5), day(5)), (day(20), day(20))]
    store.refresh(moments(spark.createDataFrame(past + [("a", day(20), 30.0)], SCHEMA)), every="day")
    feed([("a", day(21), 60.0)])
    assert judged() == [(day(5), day(5)), (day(20), day(20)), (day(21), day(21))]
    assert judged()[-1] == (day(21), day(21))  # nothing new: the progress folder knows


VALUES = [10.0, 12.0, 11.0, 30.0, 9.0, 10.0, 10.5, 14.0]


def expected_scores(values, span):
    x = pd.Series(values)
    return ((x - x.ewm(span=span).mean()) / x.ewm(span=span).std().fillna(1)).fillna(0).abs().tolist()


def feed_days(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_scores(spark, folder, root):
    days = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    scored = ordered.ordered_ewm(days, "series", "value", 3)
    return sorted((r.order_date, r.score) for r in streaming.drain(scored, "ordered", root).collect())


@pytest.fixture
def rocksdb(spark):
    ordered.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


def test_days_out_of_order_are_scored_in_order(spark, tmp_path, rocksdb):
    """Within the delay any order gives the scores of the sorted series; a restart from the progress folder does too."""
    folder, root = str(tmp_path / "days"), str(tmp_path / "out")
    row = lambda k, v=None: ("a", day(k), VALUES[k] if v is None else v)
    feed_days(spark, folder, [[row(1), row(0)], [row(3), row(4)], [row(2)]])
    begun = stream_scores(spark, folder, root)
    assert [d for d, _ in begun] == [day(0)]  # all others may still change
    feed_days(spark, folder, [[row(5), ("a", None, 1.0), ("a", day(6), None)], [row(7), row(0, 999.0)], [row(6)]])
    feed_days(spark, folder, [[(None, day(14), None)]])
    got = stream_scores(spark, folder, root)
    assert [d for d, _ in got] == [day(k) for k in range(8)]
    assert [s for _, s in got] == pytest.approx(expected_scores(VALUES, 3), abs=1e-9)


def test_moments_agree_with_the_library():
    scores = ordered.Moments(3, None)
    assert [scores.score(v) for v in VALUES] == pytest.approx(expected_scores(VALUES, 3), abs=1e-12)
