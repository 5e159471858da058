"""Event calendars: known days on which revenue is expected to move."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR_SCHEMA = "event_date date, type string, severity string, label string"

# The labelled days of the marketplace calendar (date, type, severity, label).
MARKETPLACE_EVENTS = (
    ("2016-11-25", "spike", "high", "Black Friday 2016"),
    ("2017-02-27", "drop", "medium", "Carnival Monday 2017"),
    ("2017-02-28", "drop", "high", "Carnival Tuesday 2017"),
    ("2017-05-14", "spike", "high", "Mother's Day 2017"),
    ("2017-06-12", "spike", "medium", "Dia dos Namorados 2017"),
    ("2017-09-07", "drop", "medium", "Independence Day Brazil"),
    ("2017-10-12", "spike", "medium", "Children's Day 2017"),
    ("2017-11-02", "drop", "medium", "Dia de Finados (All Souls)"),
    ("2017-11-15", "drop", "medium", "Republic Day Brazil"),
    ("2017-11-24", "spike", "high", "Black Friday 2017"),
    ("2017-11-25", "spike", "high", "Black Friday weekend 2017"),
    ("2017-12-22", "spike", "medium", "Pre-Christmas rush"),
    ("2017-12-25", "drop", "high", "Christmas Day — stores closed"),
    ("2018-01-01", "drop", "high", "New Year's Day"),
    ("2018-02-13", "drop", "high", "Carnival Tuesday 2018"),
    ("2018-03-15", "spike", "medium", "Consumer's Day 2018"),
    ("2018-05-13", "spike", "high", "Mother's Day 2018"),
    ("2018-06-12", "spike", "medium", "Dia dos Namorados 2018"),
)


def marketplace_calendar(spark: SparkSession) -> DataFrame:
    rows = [(dt.date.fromisoformat(d), kind, severity, label) for d, kind, severity, label in MARKETPLACE_EVENTS]
    return spark.createDataFrame(rows, CALENDAR_SCHEMA)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def calendar_years(days: DataFrame, column: str) -> tuple[int, int]:
    """First and last year of a date column; (1, 0), which is no year, for an empty table."""
    first, last = days.agg(F.min(F.year(column)), F.max(F.year(column))).head()
    return (first, last) if first is not None else (1, 0)


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Rule-based calendar: Christmas, New Year, Black Friday (after the 4th Thursday of November), Mother's Day."""
    rows = []
    for year in range(first_year, last_year + 1):
        rows += [
            (dt.date(year, 1, 1), "drop", "high", f"New Year's Day {year}"),
            (_nth_weekday(year, 5, 6, 2), "spike", "high", f"Mother's Day {year}"),
            (_nth_weekday(year, 11, 3, 4) + dt.timedelta(days=1), "spike", "high", f"Black Friday {year}"),
            (dt.date(year, 12, 25), "drop", "high", f"Christmas Day {year}"),
        ]
    return spark.createDataFrame(rows, CALENDAR_SCHEMA)
