"""Streams against their batch twins, late rows and state across micro-batches."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from revwatch.streaming import kpis as streaming

DAY0 = dt.datetime(2024, 3, 1)


def write_events(folder, batches):
    """One parquet file per batch, read in file-name order."""
    folder.mkdir(parents=True, exist_ok=True)
    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        path = folder / f"part-{i:03d}.parquet"
        frame.to_parquet(path)
        stamp = 1_700_000_000 + i
        os.utime(path, (stamp, stamp))


def hour(day, h=1):
    return DAY0 + dt.timedelta(days=day, hours=h)


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [
        [(1, hour(0), 1, "click", 10.0), (2, hour(0, 2), 2, "click", 5.0)],
        [(3, hour(5), 1, "click", 1.0)],
        [(6, hour(6), 1, "click", 2.0)],  # a batch drops rows older than the watermark of the batch before it
        [(4, hour(0, 3), 3, "click", 100.0), (5, hour(9), 1, "click", 1.0)],  # four: day 0 is closed by now
    ]
    write_events(tmp_path / "events", batches)
    stream = streaming.read_event_stream(spark, str(tmp_path / "events"), max_files=1)
    got = streaming.drain(streaming.stream_daily_kpis(stream, ["event_type"]), "late").orderBy("order_date").collect()
    assert [(r["order_date"].day, r["daily_value"], r["event_count"]) for r in got] == [
        (1, 15.0, 2), (6, 1.0, 1), (7, 2.0, 1),
    ]


def test_open_days_are_returned_once(spark, tmp_path):
    """A day that several batches touch has its newest totals, and days no watermark has closed are there too."""
    batches = [[(1, hour(0), 1, "click", 10.0)], [(2, hour(0, 5), 2, "click", 5.0), (3, hour(1), 2, "click", 2.0)]]
    write_events(tmp_path / "open", batches)
    stream = streaming.read_event_stream(spark, str(tmp_path / "open"), max_files=1)
    days = streaming.stream_daily_kpis(stream, ["event_type"])
    got = streaming.drain_updates(days, ["event_type", "order_date"], "open").orderBy("order_date").collect()
    assert [(r["order_date"].day, r["daily_value"], r["event_count"]) for r in got] == [(1, 15.0, 2), (2, 2.0, 1)]


def test_ewm_state_crosses_batches(spark, tmp_path):
    values = [10.0, 12.0, 11.0, 30.0, 9.0, 10.0, 10.5, 14.0]
    folder = tmp_path / "days"
    folder.mkdir()
    schema = "event_type string, order_date date, daily_value double"
    for i in range(0, 8, 2):
        rows = [("click", (DAY0 + dt.timedelta(days=j)).date(), values[j]) for j in (i + 1, i)]  # newest first
        if i == 4:
            rows.append(("click", DAY0.date(), 999.0))  # late: its day was seen in the first batch
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    days = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = streaming.drain(streaming.stream_ewm(days, "event_type", "daily_value", 3), "ewm").orderBy("order_date").collect()
    x = pd.Series(values)
    want = ((x - x.ewm(span=3).mean()) / x.ewm(span=3).std().fillna(1)).fillna(0).abs()
    assert [r["score"] for r in got] == pytest.approx(want.tolist(), abs=1e-9)


def test_whitelisted_days_do_not_alert(spark, tmp_path):
    write_events(tmp_path / "events", [[(i, hour(i), 1, "click", 1000.0) for i in range(3)]])
    baseline = spark.createDataFrame([("click", 10.0, 5.0)], "event_type string, mean double, std double")
    whitelist = spark.createDataFrame([(hour(1).date(),)], "event_date date")
    stream = streaming.read_event_stream(spark, str(tmp_path / "events"))
    got = streaming.drain(streaming.alerts(stream, baseline, ["event_type"], whitelist), "alerts")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 2]
    assert got.filter(F.col("alert") != "SPIKE").count() == 0
