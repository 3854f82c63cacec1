"""The shared scratch folder, lineage cuts, and row selection without moving whole texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors must reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{root.rstrip('/')}/veilwork-llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """The session, which from now on sends at most about ``BATCH_BYTES`` to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is computed inside goes to Python in batches of at most so many rows.

    A batch of whole texts is held several times at once: by the JVM outside its heap on the way there and back, and
    by the worker; a stage of two Python steps has two workers a core.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame, sweep: bool = False) -> None:
    """Remove tables of ``written`` that nothing still to be computed reads.

    Spark removes the shuffle files of finished queries when the driver has collected its objects as garbage,
    which may be long after; with ``sweep``, after large shuffles, it is asked to do so now.
    """
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if sweep:
        free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Ask for the shuffle files of finished queries to go; frames in cycles of Python objects would hold theirs."""
    gc.collect()
    spark._jvm.System.gc()
