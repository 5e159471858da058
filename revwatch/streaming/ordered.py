"""Exponentially weighted z-scores over a stream whose days may arrive in any order within a delay.

State is kept by RocksDB. A day waits in a map until the watermark has passed it; an event-time timer then scores all days
that are due, in order. Days later than the delay are dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Moments:
    """Weight sums and the weighted first two moments about the first value of a series."""

    SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in ("shift", "w", "w2", "wx", "wxx")])

    def __init__(self, span: int, state: tuple | None):
        self.decay = 1 - 2 / (span + 1)
        self.shift, self.w, self.w2, self.wx, self.wxx = state or (None, 0.0, 0.0, 0.0, 0.0)

    def score(self, x: float) -> float:
        """Takes the next value in and returns its |z| against the weighted mean and deviation, itself included."""
        if self.shift is None:
            self.shift = x
        y, decay = x - self.shift, self.decay
        self.w, self.w2 = self.w * decay + 1, self.w2 * decay * decay + 1
        self.wx, self.wxx = self.wx * decay + y, self.wxx * decay + y * y
        centre = self.wx / self.w
        spare = self.w * self.w - self.w2
        spread = (max(self.wxx / self.w - centre * centre, 0.0) * self.w * self.w / spare) ** 0.5 if spare > 1e-12 else 1.0
        return abs((y - centre) / spread) if spread > 0 else 0.0

    def state(self) -> tuple:
        return (self.shift, self.w, self.w2, self.wx, self.wxx)


class OrderedScores(StatefulProcessor):
    """Rows (key, order_date, value) of a series, scored in the order of their days once the watermark has passed them."""

    def __init__(self, key: str, value: str, span: int):
        self.key, self.value, self.span = key, value, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "value double")
        self.moments = handle.getValueState("moments", Moments.SCHEMA)
        self.scored = handle.getValueState("scored", "day int")

    def _last(self) -> int | None:
        return self.scored.get()[0] if self.scored.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last()
        for pdf in rows:
            for date, x in zip(pdf["order_date"], pdf[self.value], strict=True):
                if date is None or x is None or pd.isna(x):
                    continue
                day = (pd.Timestamp(date).date() - EPOCH).days
                if last is not None and day <= last:
                    continue
                self.waiting.updateValue((day,), (float(x),))
                self.handle.registerTimer((day + 1) * DAY_MS)
        yield pd.DataFrame(columns=[self.key, "order_date", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        moments = Moments(self.span, tuple(self.moments.get()) if self.moments.exists() else None)
        out = []
        for day, x in sorted((k[0], v[0]) for k, v in self.waiting.iterator()):
            if day > due:
                break
            out.append((key[0], EPOCH + dt.timedelta(days=day), moments.score(x)))
            self.waiting.removeKey((day,))
        if out:
            self.moments.update(moments.state())
            self.scored.update(((out[-1][1] - EPOCH).days,))
        yield pd.DataFrame(out, columns=[self.key, "order_date", "score"])

    def close(self) -> None:
        pass


def ordered_ewm(days: DataFrame, key: str, value: str, span: int = 7, delay: str = "3 days") -> DataFrame:
    """(key, order_date, score) for a stream of daily rows that arrive in any order within ``delay``.

    A day is scored once the watermark has passed its end: every day that arrives less than ``delay`` after the newest one
    is in its place. Of rows that share a series and a day the last one counts; null days and values are skipped. The
    session must keep streaming state in RocksDB (``use_rocksdb``).
    """
    stamped = days.select(key, "order_date", value, F.col("order_date").cast("timestamp").alias("_at")).withWatermark("_at", delay)
    schema = T.StructType([days.schema[key], T.StructField("order_date", T.DateType()), T.StructField("score", T.DoubleType())])
    return stamped.groupBy(key).transformWithStateInPandas(
        OrderedScores(key, value, span), schema, outputMode="append", timeMode="eventTime"
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, with changelogs instead of whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def closing_day(days: DataFrame, key: str, value: str, delay_days: int) -> DataFrame:
    """One row without a series, late enough for the watermark to pass the last day of ``days``: it closes a finite stream."""
    last = days.agg(F.max("order_date").alias("last"))
    fields = [F.lit(None).cast(days.schema[key].dataType).alias(key), F.date_add("last", delay_days + 2).alias("order_date")]
    return last.select(*fields, F.lit(None).cast(days.schema[value].dataType).alias(value))
