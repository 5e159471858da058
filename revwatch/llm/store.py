"""Durable intermediates and per-worker state of the text operators."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from revwatch.session import checkpoint_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a lost executor costs a re-read at most."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle width, raised to ``at_least``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def worker_state(kind: str) -> dict:
    """A dictionary that lives as long as the Python worker: loaded vocabularies and tables that its tasks share.

    Only one kind is kept at a time, so stages that follow each other in one worker do not add up.
    """
    module = sys.modules.setdefault("_revwatch_llm_state", types.ModuleType("_revwatch_llm_state"))
    if module.__dict__.get("kind") != kind:
        module.kind, module.state = kind, {}
    return module.state
