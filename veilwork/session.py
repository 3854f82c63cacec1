"""Session helpers: settings, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans in this package are written for.  All of them are
# session-level SQL settings, so they can be applied to a session made elsewhere.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(app: str = "veilwork", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("VEILWORK_DRIVER_MEMORY", "8g"))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` to an existing session and give its workers this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application; they may start anywhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input with fewer partitions than cores, for work that is heavy per row.

    A large input has more partitions than the cluster has cores and is returned as it is,
    without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


TASK_ROWS = 8192


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows out by a key, to at least as many tasks as there are cores and so many that one gets about ``rows``.

    For small rows that are made into large ones and then grouped or joined by the key: that needs no further
    shuffle, and what a task holds does not grow with the input.  Where one key alone has more rows than that,
    rows are dealt without regard to keys, and the grouping that follows shuffles as it needs to.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, largest = per_key.agg(F.sum("n"), F.max("n")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // rows))
    return df.repartition(tasks, key) if (largest or 0) <= rows else df.repartition(tasks)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    The folder must be reachable from every executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{root.rstrip('/')}/veilwork-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read the same by all that follows."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
