"""Questions that chunks of documents ask of the whole corpus, and the answers.

A chunk is some megabytes of documents in one row (`chunk`, `data`).  Its task
packs what it wants to know into one payload for each of the `n` buckets that it
has keys for; a bucket has all chunks' payloads for the keys that fall to it, and
returns one payload to each of them; these are joined to the chunks again.  A key
that is frequent in a chunk is sent once for it, so a hot key costs a few bytes a
chunk, and every step is a Spark shuffle that survives lost executors.

The number of buckets grows with the input, so that one fits a Python worker;
partitions have up to `PER_PARTITION` buckets each, sorted by Spark, and a task
holds one bucket at a time.  A chunk never has more payloads than keys, so at any
size there are no more rows than an ordinary shuffle by key would have.

A chunk's number has a checksum of its documents.  Should documents be dealt in
another way when they are read again, answers meet no chunk and the job fails.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.textops import pieces
from factweave.session import checkpoint as _checkpoint

ASKED = "bucket long, chunk long, payload binary"
#: Added to the buckets of a further question, for each that went before.
NEXT = 1 << 40
#: Buckets a partition has at most, and bytes of input a bucket stands for.
PER_PARTITION, PER_BUCKET = 64, 4 << 20
Payloads = Iterable[tuple[int, bytes]]


def tune(spark: SparkSession) -> None:
    """Arrow batches that fit a Python worker whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once into the cluster's shared checkpoint folder; shuffle files of its lineage can go then."""
    out, jvm = _checkpoint(df), df.sparkSession.sparkContext._jvm
    del df
    jvm.System.gc()  # Spark's cleaner removes the shuffle files of plans that the driver has forgotten
    return out


def collect_garbage(spark: SparkSession) -> None:
    """A full collection on every idle executor: G1 gives a heap's free part back to the system then, and not before."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """The size Spark's statistics give; the texts are counted where there are none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    texts = [c for c, kind in df.dtypes if kind == "string"]
    total = df.select(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))).alias("n")).first()["n"]
    return int(total or 0)


def buckets(df: DataFrame) -> int:
    """So many that a bucket's payloads fit a Python worker."""
    return max(16, -(-input_bytes(df) // PER_BUCKET))


def _partitions(df: DataFrame, n: int) -> int:
    return min(n, max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-n // PER_PARTITION)))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunks(df: DataFrame, columns: list[str], text: str = "text", size: int = 4 << 20) -> DataFrame:
    """(chunk, data): the columns of documents of about size bytes of text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, length = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            data = pack(pa.Table.from_batches(held))
            number = (part << 41) | (made << 24) | (zlib.crc32(data) & 0xFFFFFF)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for piece in pieces(batch, text, size):
                held.append(piece)
                length += piece.nbytes
                if length >= size:
                    yield out()
                    held, length, made = [], 0, made + 1
        if held:
            yield out()

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, "chunk long, data binary")


def asked(chunked: DataFrame, emit: Callable[..., Payloads], n: int, deal: bool = True) -> DataFrame:
    """What emit(table[, answers]) sends for each chunk, dealt out by bucket unless it is to be later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table, got in _rows(batches):
            yield from payloads([(bucket, chunk, payload) for bucket, payload in emit(table, got) if payload])

    sent = chunked.mapInArrow(run, ASKED)
    return dealt(sent, n) if deal else sent


def dealt(sent: DataFrame, n: int) -> DataFrame:
    """Payloads for n buckets, those of one bucket together."""
    p = _partitions(sent, n)
    return sent.repartitionById(p, (F.col("bucket") % p).cast("int")).sortWithinPartitions("bucket", "chunk")


def answered(asked_: DataFrame, answer: Callable[[list[tuple[int, bytes]]], Iterable[bytes]], offset: int = 0) -> DataFrame:
    """answer gets all (chunk, payload) of a bucket and gives a payload for each; offset is added to the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_turns(batches):
            held, size = [], 0
            for (chunk, _), payload in zip(rows, answer(rows), strict=True):
                if payload:
                    held.append((bucket + offset, chunk, payload))
                    size += len(payload)
                if size > 4 << 20:
                    yield from payloads(held)
                    held, size = [], 0
            yield from payloads(held)

    return asked_.mapInArrow(run, ASKED)


def by_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its (chunk, payload) in order of chunk) of dealt payloads."""
    bucket, rows = None, []
    for batch in batches:
        for b, c, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append((c, p))
    if rows:
        yield bucket, rows


def rejoined(chunked: DataFrame, *answers: DataFrame) -> DataFrame:
    """(chunk, data, answers): every chunk with its answers."""
    got = answers[0]
    for more in answers[1:]:
        got = got.unionByName(more)
    # outer, so that an answer without its chunk is seen
    return chunked.join(got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers")), "chunk", "full_outer")


def finished(joined: DataFrame, finish: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """What finish(table, answers) makes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, got in _rows(batches):
            yield from finish(table, got).to_batches()

    return joined.mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, dict[int, bytes]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            if not batch.column(1)[i].is_valid:
                raise RuntimeError("the documents came in another order when they were read again; write them as a table first")
            yield batch.column(0)[i].as_py(), unpack(batch.column(1)[i].as_py()), {x["bucket"]: x["payload"] for x in got or ()}


def payloads(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        b, c, p = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.binary())], ["bucket", "chunk", "payload"])


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, numbers of its keys, in their order) of each bucket that has any."""
    if not len(keys):
        return
    bucket = (keys % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[low]), order[low:high]


def joined_keys(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts together, and of each entry the number of its part."""
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
