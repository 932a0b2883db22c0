"""Cutting lineage in loops, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridseek.plans.sizes import MOST_ROWS, collected


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on a single machine, where none is set, a temporary one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridseek-"))
    return context.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame) -> DataFrame:
    """frame as a table of its own: plans of loops stay small, a lost executor costs no recomputation, and the planner knows its size.

    It is computed once and deleted when the program ends.
    """
    spark, path = frame.sparkSession, f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def settled(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """frame computed once: up to `most` rows are held by the driver, as a broadcast would be; more are a table."""
    return collected(frame, most) or cut(frame)
