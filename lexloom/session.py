"""Session helpers that every subpackage may use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lexloom


def ship_package() -> None:
    """Let Python workers run our functions without the package on their path.

    Functions are pickled by value, so a cluster needs no ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(lexloom)


def share(spark: SparkSession, value):
    """Broadcast a value of one of our classes; workers call :func:`shared`.

    It travels as cloudpickle bytes: Spark's own pickling names classes by module.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held):
    return cloudpickle.loads(held.value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it isn't set, a session on one machine (tests) gets a temporary folder;
    on a cluster that would be a folder of the driver alone, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Lists of the paths that ``stage`` writes, for those who collect them.
_COLLECTING: list[list[str]] = []


@contextmanager
def staged_tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that are staged inside."""
    made: list[str] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that it ran. The
    folder goes when the driver's JVM ends. Spark is told to remove the shuffle
    files of the write as soon as it ends, since the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(key, before)
    for made in _COLLECTING:
        made.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; those that are gone already don't matter."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(df: DataFrame) -> None:
    """Delete a table that :func:`stage` wrote and that nothing reads any more."""
    delete(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))
