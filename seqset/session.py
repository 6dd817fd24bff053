"""Session settings for tests and benchmarks, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int = 8, name: str = "seqset", partitions: int | None = None, work: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks, with a shuffle partition per core.

    `work` is its work folder; without one it is a temporary folder, unless Spark's defaults name another.
    """
    # a static setting: it has to be there before the session is
    given = work or SparkConf().get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "seqset")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", given)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that `spark.checkpoint.dir` names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside are removed as each query ends.

    Else they stay until the driver happens to collect its garbage, and a query of many jobs holds the files of them all.
    A stage that is needed once more makes its files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the work folder and read back.

    For a result that several later jobs read: it is computed once, and its lineage
    ends at files that survive the loss of executors. What was shuffled for it is removed.
    """
    path = f"{work_dir(df.sparkSession)}/rows"
    with passing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
