"""Small relational pieces that questions are made of: flags, ties, best relations, budgets, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.walk import solely_supported  # noqa: F401

def cross_session(scopes: Column, asked: list[str] | None) -> Column:
    """Whether a fact has none of the scopes asked for; false if none were."""
    return ~F.arrays_overlap(scopes, F.array(*map(F.lit, asked))) if asked else F.lit(False)


def own_turn(scopes: Column, session: str) -> Column:
    """Whether a fact is one session's alone; a scope above the session's doesn't count."""
    mine = lambda s: (s == session) | s.endswith(f"/{session}")
    above = lambda s: F.exists(scopes, lambda m: mine(m) & m.startswith(F.concat(s, F.lit("/"))))
    return F.exists(scopes, mine) & F.forall(scopes, lambda s: mine(s) | above(s))


def reranked(hits: DataFrame, k: int) -> DataFrame:
    """hits (content, seq, score), each content once (the first), the best k."""
    one = hits.groupBy("content").agg(F.min_by("score", "seq").alias("score"), F.min("seq").alias("seq"))
    return one.orderBy(F.desc("score"), "seq").limit(k)


def best_relations(found: DataFrame) -> DataFrame:
    """(head, tail, score) of relations (head, tail, score): the best of each pair in any case, none of a thing to itself."""
    named = found.withColumns({"h": F.lower(F.trim("head")), "t": F.lower(F.trim("tail"))}).where("h <> t and length(h) > 0 and length(t) > 0")
    best = named.groupBy("h", "t").agg(F.max_by(F.struct("head", "tail", "score"), F.struct("score", "head", "tail")).alias("x"))
    return best.select("x.head", "x.tail", "x.score")


def span_roles(edges: DataFrame) -> DataFrame:
    """(content, role): causes and effects among the ends of edges."""
    said = edges.where("label = 'causes'")
    return said.select(F.col("src").alias("content"), F.lit("cause").alias("role")).unionAll(said.select("dst", F.lit("effect"))).distinct()


def span_ties(near: DataFrame, roles: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs (query, content, score) near enough of which one is a cause and the other an effect, each once."""
    one = near.where(F.col("score") >= least).join(roles.select(F.col("content").alias("query"), F.col("role").alias("own")), "query").join(roles, "content")
    return one.where("own <> role").select(F.least("query", "content").alias("a"), F.greatest("query", "content").alias("b")).distinct()


def within_characters(lines: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """lines with used and kept: they fit the budget as far as the first that doesn't."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("used", F.sum(F.length(text)).over(w))
    return df.withColumn("kept", F.col("used") <= budget)


def subsequence_share(wanted: Column, found: Column) -> Column:
    """The share of wanted that is met in found in the same order."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        at = F.array_position(F.slice(found, s["at"], F.greatest(F.size(found) - s["at"] + 1, F.lit(0))), x)
        return F.struct((s["at"] + F.when(at > 0, at).otherwise(0)).cast("int").alias("at"), (s["n"] + (at > 0).cast("int")).alias("n"))

    return F.when(F.size(wanted) > 0, F.aggregate(wanted, start, step, lambda s: s["n"] / F.size(wanted)))


def chain_measures(cases: DataFrame) -> DataFrame:
    """Per case (case, wanted, found: arrays in order): completeness, recall, precision, and share in order."""
    both = F.size(F.array_intersect("wanted", "found"))
    some = lambda n: F.greatest(F.size(n), F.lit(1))
    return cases.select(
        "case", (both == F.size(F.array_distinct("wanted"))).alias("complete"), F.round(both / some(F.array_distinct("wanted")), 6).alias("recall"), F.round(both / some(F.array_distinct("found")), 6).alias("precision"),
        F.round(subsequence_share(F.col("wanted"), F.col("found")), 6).alias("in_order"),
    )


def chain_to(hops: DataFrame, arrived: Column) -> DataFrame:
    """hops (cause, effect, depth), in order of depth and name, up to the first that has arrived; none if none has."""
    order = F.struct("depth", "cause", "effect")
    last = hops.where(arrived).agg(F.min(order).alias("last"))
    return hops.crossJoin(F.broadcast(last)).where(order <= F.col("last")).drop("last")


def survivors(pruned: DataFrame, left: DataFrame) -> DataFrame:
    """(span): ends of pruned edges (src, dst) that what is left still reaches (node)."""
    return pruned.select(F.col("dst").alias("node")).distinct().join(left.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("span"))
