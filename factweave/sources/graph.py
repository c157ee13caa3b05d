"""Graph documents (one JSON file of nodes and edges), data sets, cases by line, and Parquet tables."""

from __future__ import annotations

import json
import pathlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import store

NODES = "content string, type string, embedding array<float>, created_at timestamp, last_accessed timestamp, scopes array<string>, invalid_at timestamp"
EDGES = "from_content string, to_content string, label string"
DATASETS = pathlib.Path(__file__).parent / "datasets"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst, label) of a graph document; a missing or broken file is an empty graph."""
    whole = _document(spark, path, f"nodes array<struct<{NODES.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGES.replace(' ', ':').replace(',:', ',')}>>")
    edges = whole.selectExpr("inline(edges)").select(F.col("from_content").alias("src"), F.col("to_content").alias("dst"), "label")
    return whole.selectExpr("inline(nodes)"), edges


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph document that read_json reads; the whole graph in one row, so for small graphs alone (see write_parquet)."""
    node = F.struct("content", "type", "embedding", "created_at", "last_accessed", F.array_sort("scopes").alias("scopes"), "invalid_at")
    edge = F.struct(F.col("src").alias("from_content"), F.col("dst").alias("to_content"), "label")
    one = nodes.agg(F.array_sort(F.collect_list(node)).alias("nodes")).crossJoin(edges.agg(F.array_sort(F.collect_list(edge)).alias("edges")))
    one.coalesce(1).write.mode("overwrite").json(path)


def datasets() -> list[str]:
    return sorted(p.stem for p in DATASETS.glob("*.json"))


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A data set document (name, description, nodes, edges with from and to); labels aren't kept."""
    schema = "name string, description string, nodes array<struct<content:string,type:string>>, edges array<struct<`from`:string,`to`:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return whole.selectExpr("inline(nodes)"), whole.selectExpr("inline(edges)").toDF("src", "dst")


def load_dataset(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (content, type) and edges (src, dst) of a built-in data set; these are small and come from the driver's files."""
    if name not in datasets():
        raise ValueError(f"no data set named {name}; there are {', '.join(datasets())}")
    held = json.loads((DATASETS / f"{name}.json").read_text())
    nodes = spark.createDataFrame([(n["content"], n["type"]) for n in held["nodes"]], "content string, type string")
    return nodes, spark.createDataFrame([(e["from"], e["to"]) for e in held["edges"]], "src string, dst string")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of an evaluation, one JSON document a line."""
    return spark.read.schema(schema).json(path)


def write_parquet(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    store.node_scopes(nodes).write.mode("overwrite").parquet(f"{path}/node_scopes")


def read_parquet(spark: SparkSession, path: str, scopes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, those with any of scopes if asked, and all edges."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if scopes:
        inside = store.in_scopes(spark.read.parquet(f"{path}/node_scopes"), scopes)
        nodes = nodes.join(inside, "content", "left_semi")
    return nodes, edges
