"""Where a plan is cut: tables and checkpoints in the folder that the session's driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session of one process, as in tests, may leave it unset:
    then it is a local folder; executors of any other session would not see that."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            folder = os.path.join(tempfile.gettempdir(), "wayside-checkpoints")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for plans that read it more than once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends, not when the driver next collects its memory: for
    actions whose rows are written, as each is planned anew and none reads what an earlier one dealt."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sent_if_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for a broadcast where it has at most so many rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
