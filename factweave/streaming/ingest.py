"""Streams of facts: duplicates removed, latest versions kept, facts enriched; by Structured Streaming.

State is a log of Parquet folders named by batch number in the stream's folder, so
a batch that is run again replaces its own and a restarted stream goes on where
it was.  A batch writes what it brings, not all that is known.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import session

#: Deltas after which a state is written as one.
COMPACT = 16


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4()}"


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The stream without repeats of keys within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def finished(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the folders <kind>-<number> that were written to their end, through the file system of the path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = [int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-")]
    return sorted(n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}-{n}/_SUCCESS")))


def _latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *sorted(set(columns) - {at}))).alias("x")).select(key, "x.*")


def state(spark: SparkSession, folder: str, key: str, at: str, below: int | None = None) -> DataFrame | None:
    """The latest row of each key: the last base and the deltas after it, below a batch if asked; None before any batch."""
    good = lambda n: below is None or n < below
    base = max((n for n in finished(spark, folder, "base") if good(n)), default=-1)
    deltas = [f"{folder}/delta-{n}" for n in finished(spark, folder, "delta") if n > base and good(n)]
    paths = ([f"{folder}/base-{base}"] if base >= 0 else []) + deltas
    return _latest(spark.read.parquet(*paths), key, at) if paths else None


def upsert(stream: DataFrame, key: str, at: str, folder: str) -> DataFrame:
    """Drains a stream of (key, at, ...) and returns the latest row per key; an empty stream gives an empty table."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        _latest(batch, key, at).write.mode("overwrite").parquet(f"{folder}/delta-{number}")
        if number % COMPACT == COMPACT - 1:
            state(own, folder, key, at).write.mode("overwrite").parquet(f"{folder}/base-{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    found = state(spark, folder, key, at)
    return spark.createDataFrame([], stream.schema) if found is None else found


def retired(stream: DataFrame, key: str, at: str, folder: str) -> DataFrame:
    """Drains a stream of versions; what each later version of a key replaced: the old row and retired_at."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        own = batch.sparkSession
        known = state(own, folder, key, at, number)
        rows = batch if known is None else batch.unionByName(known)
        order = Window.partitionBy(key).orderBy(at, *sorted(set(batch.columns) - {key, at}))
        over = rows.withColumn("retired_at", F.lead(at).over(order)).where("retired_at is not null")
        over.write.mode("overwrite").parquet(f"{folder}/retired-{number}")
        _latest(batch, key, at).write.mode("overwrite").parquet(f"{folder}/delta-{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    done = [f"{folder}/retired-{n}" for n in finished(spark, folder, "retired")]
    return spark.read.parquet(*done) if done else spark.createDataFrame([], stream.schema).withColumn("retired_at", F.col(at))


def enriched(stream: DataFrame, folder: str, plan: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Drains a stream of texts (seq, text, scopes): facts first, then the nodes and edges that plan finds in them.

    A batch whose enrichment fails is run again by the stream; its facts are there already.
    """
    spark = stream.sparkSession

    def enrich(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/facts-{number}")
        nodes, edges = plan(batch.sparkSession.read.parquet(f"{folder}/facts-{number}"))
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes-{number}")
        edges.write.mode("overwrite").parquet(f"{folder}/edges-{number}")

    stream.writeStream.foreachBatch(enrich).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    read = lambda kind: spark.read.parquet(*(f"{folder}/{kind}-{n}" for n in finished(spark, folder, kind)))
    return read("nodes"), read("edges")


def pending(spark: SparkSession, folder: str) -> int:
    """Batches whose facts are stored and whose nodes aren't yet."""
    return len(set(finished(spark, folder, "facts")) - set(finished(spark, folder, "nodes")))
