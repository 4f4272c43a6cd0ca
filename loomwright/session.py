"""Spark session and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomwright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver has it; clusters get it as --py-files or installed."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    if folder not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (folder, known.get("PYTHONPATH")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without: it gets a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/loomwright/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in scratch() that nothing has yet."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _file_system(spark, path)
    return system.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table; nothing happens if it isn't there."""
    system, there = _file_system(spark, path)
    system.delete(there, True)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that haven't been written yet can't be read any more."""
    remove(spark, scratch(spark))


_OPEN: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Intermediate tables made inside are deleted at the end; so results must have been written elsewhere by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not made]
        for path in made:
            remove(spark, path)


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Python workers get at most so many rows at once from what is run inside; for wide rows."""
    before = spark.conf.get(ROWS, None)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before) if before is not None else spark.conf.unset(ROWS)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
