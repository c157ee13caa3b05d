"""Session helpers: tables, and checkpoints in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; lineage ends there and survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/{uuid.uuid4()}")
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that fit a Python worker, also of rows that hold packs of vectors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, name: str, inputs: list[str], make) -> str:
    """A folder that make(folder) has filled, once for each application and state of the inputs, which are paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    state = []
    for path in inputs:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        state.append((path, fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()))
    key = hashlib.sha256(repr(state).encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}/{name}-{key}"
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_done")
    fs = done.getFileSystem(conf)
    if not fs.exists(done):
        fs.delete(done.getParent(), True)  # what an attempt that failed has left
        make(folder)
        fs.create(done).close()
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
