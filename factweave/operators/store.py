"""Writes and lookups on nodes(content, type, embedding, created_at, last_accessed, scopes, invalid_at) and edges(src, dst, label).

Tables are never changed in place: every write gives new DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "content string, type string, embedding array<float>, created_at timestamp, last_accessed timestamp, scopes array<string>, invalid_at timestamp"
EDGES = "src string, dst string, label string"


def upsert_nodes(existing: DataFrame, batch: DataFrame, key: str = "content", first: tuple[str, ...] = (), scopes: str = "scopes") -> DataFrame:
    """Existing rows win, then the batch's first (by seq, negative for existing); scopes are united."""
    both = existing.unionByName(batch)
    return both.groupBy(key).agg(*(F.min_by(c, "seq").alias(c) for c in first), F.array_sort(F.array_distinct(F.flatten(F.collect_list(scopes)))).alias(scopes))


def insert_nodes(nodes: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """nodes with batch (content, type, embedding, created_at, scopes, seq).

    A node that exists keeps what it is, gets the new scopes too, counts as accessed now and is valid again; of a new one
    the first row counts.  A batch row without embedding is an error.
    """
    new = batch.select("content", "type", F.when(F.assert_true(F.col("embedding").isNotNull(), F.lit("a node needs an embedding")).isNull(), F.col("embedding")).alias("embedding"), "created_at", "scopes", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("last_accessed"), F.lit(None).cast("timestamp").alias("invalid_at"))
    both = nodes.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    united = upsert_nodes(both.limit(0), both.select("content", "type", "embedding", "created_at", "last_accessed", "invalid_at", "scopes", "seq"), first=("type", "embedding", "created_at", "last_accessed", "invalid_at"))
    touched = both.groupBy("content").agg(F.max(F.col("seq") >= 0).alias("touched"))
    out = united.join(touched, "content")
    return out.select(
        "content", "type", "embedding", "created_at", F.when(F.col("touched"), now).otherwise(F.col("last_accessed")).alias("last_accessed"), "scopes", F.when(~F.col("touched"), F.col("invalid_at")).alias("invalid_at")
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst): the last label that isn't null, by seq."""
    return edges.groupBy("src", "dst").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("seq"))).alias("label"))


def insert_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """edges with batch (src, dst, label, seq); with nodes, only edges between them."""
    both = merge_edges(edges.select("src", "dst", "label", F.lit(-1).cast("long").alias("seq")).unionByName(batch.select("src", "dst", "label", F.col("seq").cast("long").alias("seq"))))
    if nodes is not None:
        keys = nodes.select("content")
        both = both.join(keys.withColumnRenamed("content", "src"), "src", "left_semi").join(keys.withColumnRenamed("content", "dst"), "dst", "left_semi")
    return both.select("src", "dst", "label")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without gone(content), and edges without an end there."""
    keys = gone.select("content").distinct()
    kept = edges.join(keys.withColumnRenamed("content", "src"), "src", "left_anti").join(keys.withColumnRenamed("content", "dst"), "dst", "left_anti")
    return nodes.join(keys, "content", "left_anti"), kept.select(*edges.columns)


def neighbours_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Contents at the other end of an edge of keys(content)."""
    ends = edges.select(F.col("src").alias("content"), F.col("dst").alias("other")).unionAll(edges.select("dst", "src"))
    return ends.join(keys.select("content"), "content", "left_semi").select(F.col("other").alias("content")).distinct()


def orphans(entities: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities (content) without a fact at the other end of an edge, in either direction."""
    ends = edges.select(F.col("src").alias("content"), F.col("dst").alias("other")).unionAll(edges.select("dst", "src"))
    held = ends.join(facts.select(F.col("content").alias("other")), "other", "left_semi").select("content")
    return entities.join(held, "content", "left_anti")


def purge_orphans(nodes: DataFrame, edges: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, purged): without those entities of suspects(content) that no fact has an edge with."""
    entities = nodes.where("type = 'entity'").join(suspects.select("content").distinct(), "content", "left_semi").select("content")
    purged = orphans(entities, nodes.where("type = 'text'").select("content"), edges)
    return (*delete_nodes(nodes, edges, purged), purged)


def forget(node_scopes: DataFrame, scopes: list[str]) -> DataFrame:
    """(content, deleted): of the nodes with any of scopes, whether they have no other."""
    inside = F.col("scope").isin(scopes)
    return node_scopes.groupBy("content").agg(F.max(inside.cast("int")).alias("hit"), F.min(inside.cast("int")).alias("only")).where("hit = 1").select("content", (F.col("only") == 1).alias("deleted"))


def node_scopes(nodes: DataFrame) -> DataFrame:
    return nodes.select("content", F.explode("scopes").alias("scope")).distinct()


def remove_scopes(nodes: DataFrame, keys: DataFrame | None, scopes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, removed (content, scope)): scopes taken from keys(content), or from all."""
    asked = node_scopes(nodes).where(F.col("scope").isin(scopes))
    if keys is not None:
        asked = asked.join(keys.select("content").distinct(), "content", "left_semi")
    hit = asked.select("content", F.lit(True).alias("_hit")).distinct()
    left = nodes.join(hit, "content", "left").withColumn("scopes", F.when(F.col("_hit"), F.array_except("scopes", F.array(*map(F.lit, scopes)))).otherwise(F.col("scopes"))).drop("_hit")
    return left, asked


def set_invalid(nodes: DataFrame, keys: DataFrame, when: Column) -> DataFrame:
    """nodes, those of keys(content) that exist stamped with when."""
    hit = keys.select("content", F.lit(True).alias("_hit")).distinct()
    return nodes.join(hit, "content", "left").withColumn("invalid_at", F.when(F.col("_hit"), when).otherwise(F.col("invalid_at"))).drop("_hit")


def stale(nodes: DataFrame, now: Column, days: int) -> DataFrame:
    """Nodes last accessed strictly before now - days."""
    return nodes.where(F.col("last_accessed") < now - F.expr(f"INTERVAL {days} DAYS"))


def touch(nodes: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    hit = keys.select("content", F.lit(True).alias("_hit")).distinct()
    return nodes.join(hit, "content", "left").withColumn("last_accessed", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed"))).drop("_hit")


def lookup(nodes: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Columns of the nodes in keys(content); missing ones are left out."""
    return nodes.join(keys.select("content").distinct(), "content", "left_semi").select("content", *columns)


def scopes_of(node_scopes_: DataFrame, keys: DataFrame) -> DataFrame:
    """(content, scopes) of keys(content); contents without a scope are left out."""
    return node_scopes_.join(keys.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))


def list_scopes(node_scopes: DataFrame, prefix: str = "") -> DataFrame:
    return node_scopes.where(F.col("scope").startswith(prefix)).select("scope").distinct()


def in_scopes(node_scopes: DataFrame, scopes: list[str]) -> DataFrame:
    """Contents with any of scopes."""
    return node_scopes.where(F.col("scope").isin(scopes)).select("content").distinct()


def chosen(nodes: DataFrame, type: str | None = None, scopes: list[str] | None = None) -> DataFrame:
    """Nodes of a type and with any of scopes, where given."""
    out = nodes if type is None else nodes.where(F.col("type") == type)
    return out.where(F.arrays_overlap("scopes", F.array(*map(F.lit, scopes)))) if scopes else out


def count_nodes(nodes: DataFrame, type: str | None = None, scopes: list[str] | None = None) -> DataFrame:
    return chosen(nodes, type, scopes).agg(F.count(F.lit(1)).alias("n"))


def starting_with(nodes: DataFrame, word: str, limit: int = 20) -> DataFrame:
    """Entities that are the word or begin with it as a word, in any case, the first by name."""
    low = F.lower("content")
    return nodes.where((F.col("type") == "entity") & ((low == word.lower()) | low.startswith(f"{word.lower()} "))).select("content").orderBy("content").limit(limit)


def causal_relations(edges: DataFrame) -> DataFrame:
    """(fact, cause, effect): cause -causes-> effect, and both have an edge to the fact.

    The relation is joined to a fact's own edges by both ends at once: per fact, its ends are paired through the causes
    edges, so a frequent cause meets only the facts that it has an edge to.
    """
    c = edges.where("label = 'causes'").select(F.col("src").alias("cause"), F.col("dst").alias("effect"))
    plain = edges.where("label is null")
    a = plain.select(F.col("src").alias("cause"), F.col("dst").alias("fact"))
    b = plain.select(F.col("src").alias("effect"), F.col("dst").alias("fact"))
    return c.join(a, "cause").join(b, ["effect", "fact"]).select("fact", "cause", "effect").distinct()


def relations_by_fact(edges: DataFrame) -> DataFrame:
    """(fact, causes): its relations in order of cause and effect."""
    return causal_relations(edges).groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("cause", "effect"))).alias("causes"))


def valid_at(nodes: DataFrame, when: Column) -> DataFrame:
    return nodes.where((F.col("created_at").isNull() | (F.col("created_at") <= when)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > when)))


def supersession(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(content, supersedes, superseded_by) of keys(content), by edges labelled supersedes, new to old."""
    over = edges.where("label = 'supersedes'")
    out = over.groupBy(F.col("src").alias("content")).agg(F.array_sort(F.collect_set("dst")).alias("supersedes"))
    back = over.groupBy(F.col("dst").alias("content")).agg(F.array_sort(F.collect_set("src")).alias("superseded_by"))
    none = F.array().cast("array<string>")
    both = keys.select("content").distinct().join(out, "content", "left").join(back, "content", "left")
    return both.select("content", F.coalesce("supersedes", none).alias("supersedes"), F.coalesce("superseded_by", none).alias("superseded_by"))
