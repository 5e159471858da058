"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "revwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution, no web page)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and executors share one disk,
    may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = os.path.join(tempfile.gettempdir(), f"revwatch-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediates that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, so that two calls never meet."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Folders made in each open ``intermediates`` scope of a thread, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, what ``materialize`` wrote inside it. Whatever was built there must have been run by then."""
    made: list[str] = []
    _SCOPES.open.append(made)
    try:
        yield
    finally:
        _SCOPES.open.pop()  # by place: lists of two scopes may be equal
        for path in made:
            drop_path(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The table lives as long as the scope around it, or with the application where there is none or ``keep`` is set.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _SCOPES.open and not keep:
        _SCOPES.open[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
