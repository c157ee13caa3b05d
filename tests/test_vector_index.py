"""The stored vector index: recall on the given tables, later batches, edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import search
from factweave.operators.vector_index import Model, VectorIndex
from factweave.plans.queries import g_vec

NODES = "content string, embedding array<float>"


def pairs(df):
    return {(r["query"], r["content"]) for r in df.select("query", "content").collect()}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_with_a_sixth_of_the_nodes_compared(spark, tmp_path, folder):
    v = g_vec(spark, f"/root/testdata/{folder}").select("content", "embedding", "vec_id")
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("content", "query")
    index = VectorIndex.fit(v, str(tmp_path / "index"))
    exact = pairs(search.knn_join(asked, v, 10))
    assert len(exact & pairs(index.search(asked, 10))) >= 0.95 * len(exact)
    compared = index.shortlist(asked, 81).groupBy("query").count().agg(F.max("count")).first()[0]
    assert compared <= v.count() / 6


def test_more_batches_without_a_new_fit(spark, tmp_path):
    v = g_vec(spark, "/root/testdata/sf0.1").select("content", "embedding", "vec_id")
    first, rest = v.where("vec_id < 1000"), v.where("vec_id >= 1000")
    index = VectorIndex.fit(first, str(tmp_path / "index"))
    model = sorted(os.listdir(tmp_path / "index" / "model"))
    again = VectorIndex(spark, str(tmp_path / "index"))
    again.add(rest)
    assert sorted(os.listdir(tmp_path / "index" / "model")) == model
    assert again.nodes().count() == 2000 and again.nodes().select("batch", "number").distinct().count() == 2000
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("content", "query")
    exact = pairs(search.knn_join(asked, v, 10))
    found = pairs(again.search(asked, 10))
    assert len(exact & found) >= 0.9 * len(exact)
    assert any(int(c[1:]) >= 1000 for _, c in found)
    assert index.model.probe == again.model.probe


def test_clusters_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16)) * 4
    rows = [(f"n{i}", (centre[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(4000)]
    nodes = spark.createDataFrame(rows, NODES)
    index = VectorIndex.fit(nodes, str(tmp_path / "index"), recall=0.98)
    assert index.model.probe <= len(index.model.centres) / 3
    asked = nodes.where("substr(content, -2) = '00'").withColumnRenamed("content", "query")
    exact = pairs(search.knn_join(asked, nodes, 10))
    assert len(exact & pairs(index.search(asked, 10))) >= 0.9 * len(exact)


def test_all_that_is_near_when_all_is_compared(spark, tmp_path):
    """With lists and short lists as long as the table the index is exact, zeros, ties and equal contents' order too."""
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(90)] + [("zero", [0.0] * 6), ("none", None)]
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    index = VectorIndex.fit(nodes, str(tmp_path / "index"), lists=5)
    asked = nodes.where("content in ('n1', 'n2', 'zero', 'none')").withColumnRenamed("content", "query")
    want = search.knn_join(asked.where("embedding is not null"), nodes.where("embedding is not null"), 7)
    found = index.search(asked, 7, factor=20, probe=5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_an_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], NODES)
    index = VectorIndex.fit(empty, str(tmp_path / "index"))
    assert index.search(empty.withColumnRenamed("content", "query"), 3).collect() == []


def test_products_are_those_of_the_decoded_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 10))
    model = Model.fitted(x, 4, 4, 0.9, 5)
    own, codes = model.coded(x)
    decoded = model.centres[own] + model.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :10]
    asked = rng.normal(size=(3, 10))
    table = model.products(asked)
    scores = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ decoded.T
    by_code = table[:, np.arange(codes.shape[1]), codes].sum(2) + (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ model.centres[own].T
    assert np.allclose(scores, by_code)


def test_near_copies_are_told_apart(spark, tmp_path):
    """A group of near copies that is far longer than a short list: nine or more of each query's ten nearest are found."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 64))
    rows = [(f"n{i}", (base[i % 20] + 0.08 * rng.normal(size=64)).tolist()) for i in range(8000)]
    nodes = spark.createDataFrame(rows, NODES).repartition(8)
    index = VectorIndex.fit(nodes, str(tmp_path / "index"))
    asked = nodes.where("substr(content, -2) = '00'").withColumnRenamed("content", "query")
    exact, found = pairs(search.knn_join(asked, nodes, 10)), pairs(index.search(asked, 10))
    missed = [q for q, _ in exact - found]
    assert max(missed.count(q) for q in set(missed) | {""}) <= 1


def test_batches_of_packs_are_small(spark, tmp_path):
    """Packs are hundreds of kilobytes, so Arrow batches of thousands of them would not fit."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    nodes = spark.createDataFrame([(f"n{i}", [float(i), 1.0]) for i in range(30)], NODES)
    VectorIndex.fit(nodes, str(tmp_path / "index")).search(nodes.withColumnRenamed("content", "query"), 3)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(4 << 20)
