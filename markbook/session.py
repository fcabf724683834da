"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session. On a cluster, build the session there; no operator depends on this one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("markbook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="markbook-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``, with its file system.

    A name without one is completed here, once, as Spark reads it, so that tasks which open files there go to the same place.
    Only a local session may go without the setting: it then gets a temporary folder of this process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster job needs a shared folder")
        return _local_dir()
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one."""
    return os.path.join(shared_dir(spark), "markbook", f"{purpose}-{uuid.uuid4().hex}")


def settled(df: DataFrame, purpose: str = "step") -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
