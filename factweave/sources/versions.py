"""Versioned tables: a commit log with snapshot reads, deltas by key merged on read, conflicts seen and retried.

A folder holds `_log`, a small file for each version, and `data`, a directory for
each commit with the rows that it writes, dealt to directories by a checksum of the
key.  A commit writes its own rows only, whatever the table's size, and then its log
entry; an entry is never replaced, so of two writers that want the same version one
takes the next.  A writer that has read a snapshot fails if a commit since then wrote
to one of its buckets, and `update` then reads and computes anew.

A read merges what the log says: the last compaction and the commits after it.  For
each key the rows after its last deletion are united column by column.  `compact`
writes the merged rows as a commit that stands for all before it; older versions stay
readable.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[Column, Column], Column]


class Conflict(RuntimeError):
    """Another commit wrote to the same buckets since the snapshot was read."""


def latest(column: Column, order: Column) -> Column:
    return F.max_by(F.struct(column.alias("v")), order)["v"]


def latest_known(column: Column, order: Column) -> Column:
    """The last value that isn't null."""
    return F.max_by(column, F.when(column.isNotNull(), order))


def earliest(column: Column, order: Column) -> Column:
    return F.min_by(F.struct(column.alias("v")), order)["v"]


def least(column: Column, order: Column) -> Column:
    return F.min(column)


def union(column: Column, order: Column) -> Column:
    """The distinct elements of arrays, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


class VersionedTable:
    """The table in a folder, with keys, other columns (DDL) and how each of these is merged; `latest` unless said."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, columns: str, merges: dict[str, Merge] | None = None, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.keys = [f.name for f in T._parse_datatype_string(keys).fields]
        self.columns = [f.name for f in T._parse_datatype_string(columns).fields]
        self.merges = {c: latest for c in self.columns} | (merges or {})
        self.schema = T._parse_datatype_string(f"{keys}, {columns}, _gone boolean, _place long, _commit string, bucket int")

    # the log

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        fs, log = self._fs(), self._path("_log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def entry(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"_log/{version:020}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, entry: dict) -> bool:
        """Writes a log entry, all of it or nothing; False if there is one of this version."""
        fs, jvm = self._fs(), self.spark._jvm
        made, name = self._path(f"_log/.{uuid.uuid4()}"), self._path(f"_log/{entry['version']:020}.json")
        stream = fs.create(made)
        stream.write(json.dumps(entry).encode())
        stream.close()
        try:
            if fs.getScheme() == "file":  # a rename would replace there
                at = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (name, made)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, name, options)
            return True
        except Exception:
            if fs.exists(name):
                return False
            raise
        finally:
            fs.delete(made, False)

    # writes

    def _write(self, rows: DataFrame | None, gone: DataFrame | None) -> dict:
        commit, parts = str(uuid.uuid4()), []
        place = F.col("seq").cast("long") if rows is not None and "seq" in rows.columns else F.monotonically_increasing_id()
        if rows is not None:
            parts.append(rows.select(*self.keys, *self.columns, F.lit(False).alias("_gone"), place.alias("_place")))
        if gone is not None:  # before the rows of the same commit
            none = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]
            parts.append(gone.select(*self.keys).distinct().select(*self.keys, *none, F.lit(True).alias("_gone"), F.lit(-(1 << 62)).alias("_place")))
        bucket = F.coalesce(F.crc32(F.concat_ws("\0", *(F.col(k).cast("string") for k in self.keys))) % self.buckets, F.lit(0)).cast("int")
        df = reduce(DataFrame.unionByName, parts).select("*", F.lit(commit).alias("_commit"), bucket.alias("bucket"))
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{commit}")
        held = sorted(int(s.getPath().getName()[7:]) for s in self._fs().listStatus(self._path(f"data/{commit}")) if s.getPath().getName().startswith("bucket="))
        return {"commit": commit, "buckets": held, "deletes": gone is not None}

    def commit(self, rows: DataFrame | None = None, gone: DataFrame | None = None, read: int | None = None) -> int:
        """Writes rows (keys, columns, maybe seq) and deletes the keys of gone first; the new version.

        With read, the version of a snapshot that the rows come from, commits to the same buckets since then are a
        Conflict; what was written is removed then.
        """
        entry = self._write(rows, gone)
        checked = read
        while True:
            now = self.version()
            if checked is not None:
                for v in range(checked + 1, now + 1):
                    other = self.entry(v)
                    if other.get("base") is None and set(other["buckets"]) & set(entry["buckets"]):
                        self._fs().delete(self._path(f"data/{entry['commit']}"), True)
                        raise Conflict(f"version {v} wrote to the same buckets as this commit, which read version {read}")
                checked = now
            if self._put(entry | {"version": now + 1}):
                return now + 1

    def update(self, change: Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]], attempts: int = 5) -> int:
        """Commits what change(snapshot) gives as (rows, gone); reads and computes anew after a conflict."""
        for left in range(attempts - 1, -1, -1):
            read = self.version()
            try:
                return self.commit(*change(self.read(read)), read=read)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self) -> int:
        """Writes the merged rows as a commit that stands for all before it."""
        read = self.version()
        entry = self._write(self.read(read).withColumn("seq", F.lit(0)), None) | {"base": read}
        while not self._put(entry | {"version": (now := self.version() + 1)}):
            pass
        return now

    # reads

    def commits(self, version: int) -> list[dict]:
        """The entries that a version is merged from, the compaction first."""
        entries, base, v = [], None, version
        while v > (base["base"] if base else 0):
            e = self.entry(v)
            if e.get("base") is None:
                entries.append(e)
            elif base is None:
                base = e
            v -= 1
        return ([base | {"version": base["base"]}] if base else []) + entries[::-1]

    def read(self, version: int | None = None, of: list[tuple] | None = None) -> DataFrame:
        """(keys, columns) as of a version; of some keys only, whose buckets alone are read."""
        version = self.version() if version is None else version
        live = self.commits(version)
        if not live:
            return self.spark.createDataFrame([], self.schema).select(*self.keys, *self.columns)
        paths = [f"{self.folder}/data/{e['commit']}" for e in live]
        df = self.spark.read.schema(self.schema).option("recursiveFileLookup", "false").parquet(*paths) if len(paths) == 1 else reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in paths])
        if of is not None:
            said = ["\0".join(str(x) for x in key if x is not None).encode() for key in of]
            wanted = self.spark.createDataFrame(of, T.StructType([self.schema[k] for k in self.keys]))
            df = df.where(F.col("bucket").isin(sorted({zlib.crc32(x) % self.buckets for x in said}))).join(F.broadcast(wanted), self.keys, "left_semi")
        number = F.element_at(F.create_map(*(F.lit(x) for e in live for x in (e["commit"], e["version"]))), F.col("_commit"))
        df = df.withColumn("_order", F.struct(number.alias("version"), "_place"))
        if any(e["deletes"] for e in live):
            last = df.where("_gone").groupBy(*self.keys).agg(F.max("_order").alias("_last")).select(*(F.col(k).alias(f"_{k}") for k in self.keys), "_last")
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys))
            df = df.join(last, same, "left").where("not _gone and (_last is null or _order > _last)")
        return df.groupBy(*self.keys).agg(*(self.merges[c](F.col(c), F.col("_order")).alias(c) for c in self.columns))
