"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job here relies on; safe to call many times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # rows of whole texts: a batch and the arrays a task makes of it stay small beside the heap
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def local_session(name: str = "metricloom", cpus: str = "*", memory: str = "12g") -> SparkSession:
    """A one-machine session for tests and benchmarks."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only where Spark runs inside this one process and no folder is named, one is made for the
    length of the process.
    """
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
    )
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="metricloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Everything one application writes between its steps."""
    return f"{shared_folder(spark)}/metricloom/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written between its steps; earlier results are then unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in this run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []  # open blocks, innermost last


@contextmanager
def scratch(spark: SparkSession):
    """What ``materialize`` writes within the block is deleted at its end, unless it says ``keep``."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for text in paths:
            path = jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive frame feeds several aggregations: unlike a cache, the files survive
    the loss of an executor and the lineage ends here. ``keep`` leaves them past the end of a
    ``scratch`` block.
    """
    path = work_dir(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
