"""Versioned tables: snapshots, two writers, deletions, compaction, cost of a commit."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from factweave.sources import versions
from factweave.sources.versions import Conflict, VersionedTable

KEYS, COLUMNS = "content string", "type string, scopes array<string>, n long"
ROWS = f"{KEYS}, {COLUMNS}"


def made(spark, path, **how):
    return VersionedTable(spark, str(path), KEYS, COLUMNS, {"scopes": versions.union, "type": versions.earliest}, **how)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_snapshots_and_merges(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    assert table.version() == 0 and table.read().collect() == []
    assert table.commit(rows(spark, ("a", "x", ["s"], 1), ("b", "x", [], 1), (None, "x", None, 7))) == 1
    assert table.commit(rows(spark, ("a", "y", ["r", "s"], 2))) == 2
    assert got(table.read(1)) == [("a", "x", ["s"], 1), ("b", "x", [], 1), (None, "x", [], 7)]
    assert got(table.read()) == [("a", "x", ["r", "s"], 2), ("b", "x", [], 1), (None, "x", [], 7)]
    again = made(spark, tmp_path / "t")
    assert again.version() == 2 and got(again.read()) == got(table.read())


def test_rows_of_one_commit_are_in_order_of_seq(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.commit(rows(spark, *(("a", str(i), [], i) for i in range(9))).withColumn("seq", -F.col("n")).repartition(4))
    assert got(table.read()) == [("a", "8", [], 0)]


def test_deleted_keys_begin_anew(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.commit(rows(spark, ("a", "x", ["s"], 1), ("b", "x", ["s"], 1)))
    table.commit(gone=spark.createDataFrame([("a",), ("nowhere",)], KEYS))
    assert got(table.read()) == [("b", "x", ["s"], 1)]
    table.commit(rows(spark, ("a", "z", ["q"], 5)), spark.createDataFrame([("b",)], KEYS))
    assert got(table.read()) == [("a", "z", ["q"], 5)]
    assert got(table.read(1)) == [("a", "x", ["s"], 1), ("b", "x", ["s"], 1)]
    table.compact()
    assert got(table.read()) == [("a", "z", ["q"], 5)]


def test_compaction_stands_for_what_was_before(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    for i in range(4):
        table.commit(rows(spark, ("a", str(i), [f"s{i}"], i), (f"k{i}", "x", [], i)))
    before = got(table.read())
    assert table.compact() == 5 and len(table.commits(5)) == 1
    assert got(table.read()) == before and got(table.read(2)) == [("a", "0", ["s0", "s1"], 1), ("k0", "x", [], 0), ("k1", "x", [], 1)]
    table.commit(rows(spark, ("a", "new", ["s9"], 9)))
    assert [r for r in got(table.read()) if r[0] == "a"] == [("a", "0", ["s0", "s1", "s2", "s3", "s9"], 9)]
    assert len(table.commits(6)) == 2


def test_a_commit_during_a_compaction_is_kept(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path / "t")
    table.commit(rows(spark, ("a", "x", ["s"], 1)))
    write = table._write

    def slow(*args):
        entry = write(*args)
        monkeypatch.setattr(table, "_write", write)
        table.commit(rows(spark, ("a", "y", ["late"], 2), ("c", "y", [], 2)))
        return entry

    monkeypatch.setattr(table, "_write", slow)
    assert table.compact() == 3
    assert got(table.read()) == [("a", "x", ["late", "s"], 2), ("c", "y", [], 2)]


def counted(snapshot):
    """One more for key a."""
    n = snapshot.where("content = 'a'").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return rows(snapshot.sparkSession, ("a", "x", [], n + 1)), None


def test_two_writers_of_one_key(spark, tmp_path):
    """Both read the same version; the one that comes second sees it and counts anew."""
    table, tried, meet = made(spark, tmp_path / "t"), [], threading.Barrier(2)
    table.commit(rows(spark, ("a", "x", [], 0)))

    def write():
        def change(snapshot):
            tried.append(1)
            out = counted(snapshot)
            if len(tried) <= 2:
                meet.wait()
            return out

        made(spark, tmp_path / "t").update(change)

    writers = [threading.Thread(target=write) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert table.version() == 3 and len(tried) == 3
    assert got(table.read()) == [("a", "x", [], 2)]


def test_a_conflict_is_said_and_leaves_nothing(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.commit(rows(spark, ("a", "x", [], 0)))
    table.commit(rows(spark, ("a", "x", [], 1)))
    with pytest.raises(Conflict):
        table.commit(rows(spark, ("a", "x", [], 9)), read=1)
    assert table.version() == 2 and len(os.listdir(tmp_path / "t" / "data")) == 2
    other = next(k for k in "bcdefgh" if table.commit(rows(spark, (k, "x", [], 0))) and table.entry(table.version())["buckets"] != table.entry(2)["buckets"])
    assert table.commit(rows(spark, (other, "x", [], 1)), read=table.version()) == table.version()
    with pytest.raises(Conflict):
        table.update(lambda snapshot: (table.commit(rows(spark, ("a", "x", [], 5))) and rows(spark, ("a", "x", [], 6)), None), attempts=2)


def test_an_entry_is_never_replaced(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.commit(rows(spark, ("a", "x", [], 0)))
    assert not table._put({"version": 1, "commit": "other", "buckets": [], "deletes": False})
    assert table.entry(1)["commit"] != "other" and len([n for n in os.listdir(tmp_path / "t" / "_log") if n.endswith(".json") and n[0] != "."]) == 1


def test_a_commit_costs_what_it_writes(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.commit(spark.range(50_000).selectExpr("concat('k', id) AS content", "'x' AS type", "array('s') AS scopes", "id AS n"))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "t") for f in names)
    before = size()
    table.commit(rows(spark, ("k7", "y", ["r"], 0)))
    assert size() - before < before / 50
    assert len(table.entry(2)["buckets"]) == 1


def test_some_keys_are_read_from_their_buckets(spark, tmp_path):
    import shutil

    table = made(spark, tmp_path / "t")
    table.commit(spark.range(500).selectExpr("concat('k', id) AS content", "'x' AS type", "array('s') AS scopes", "id AS n"))
    table.commit(rows(spark, ("k7", "y", ["r"], -1)), spark.createDataFrame([("k8",)], KEYS))
    want = [("k7", "x", ["r", "s"], -1)]
    assert got(table.read(of=[("k7",), ("k8",), ("none",)])) == want
    import zlib

    own = {f"bucket={zlib.crc32(k) % 16}" for k in (b"k7", b"k8")}
    for commit in os.listdir(tmp_path / "t" / "data"):
        for name in os.listdir(tmp_path / "t" / "data" / commit):
            if name.startswith("bucket=") and name not in own:
                shutil.rmtree(tmp_path / "t" / "data" / commit / name)
    assert got(table.read(of=[("k7",), ("k8",)])) == want
