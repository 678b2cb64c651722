"""Session helpers: UTC, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "tremorline", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session the cluster gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TREMORLINE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the data model are UTC; epoch arithmetic relies on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; also done when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


_told: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    def drop() -> None:
        if spark.sparkContext._jsc is not None:  # a stopped session has nothing left to ask
            drop_tables(spark)

    if (app := spark.sparkContext.applicationId) not in _told:
        _told.add(app)
        atexit.register(drop)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages never recompute what is behind it, whichever executors are lost, and read only the columns they use.
    Tables live below a folder of the application, which goes when the driver ends or by ``drop_tables``.
    """
    spark = df.sparkSession
    _drop_at_exit(spark)
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
