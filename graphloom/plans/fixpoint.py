"""Cutting the lineage of iterative plans, and dealing large tables over enough tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task of a shuffle, about and at most where keys are even.
ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: later rounds do not go back before it, and plan with its true size."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by its keys over as many tasks as its rows need, so that a task's memory does not grow with the table; as it is where the session's shuffle partitions are enough."""
    need = -(-(df.count() if rows is None else rows) // ROWS)
    return df.repartition(need, *keys) if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
