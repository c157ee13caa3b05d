"""Level-synchronous walks: neighbours, discovery with parents, causal reach, chains, counterfactuals.

Each level is one join of the frontier with the edges and one anti join with what
was visited, checkpointed in the shared folder.  Levels are few; the frontier is
a DataFrame of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.session import checkpoint


def directed(edges: DataFrame) -> DataFrame:
    """(src, nbr, label, direction): each edge from both of its ends."""
    out = edges.select("src", F.col("dst").alias("nbr"), "label", F.lit("out").alias("direction"))
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("nbr"), "label", F.lit("in").alias("direction"))
    return out.unionAll(back)


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, nbr, label, direction), one row per pair: labelled before unlabelled, then out before in, then by label."""
    w = Window.partitionBy("src", "nbr").orderBy(F.col("label").isNull(), F.desc("direction"), "label")
    return directed(edges).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def nearest(adjacent: DataFrame, limit: int) -> DataFrame:
    """Per src of (src, nbr, score) its nearest; Spark keeps `limit` rows a key before the shuffle."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "nbr")
    return adjacent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def held(edges: DataFrame) -> DataFrame:
    """edges (src, dst), each once and written once, so that levels don't derive them again."""
    return checkpoint(edges.select("src", "dst").distinct())


#: Rows of a frontier or of what was visited that are broadcast; they are counted before.
FEW = 100_000


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def reach(edges: DataFrame, starts: DataFrame, depth: int, allowed: Column | None = None, blocked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, depth, parent) of what starts(node) reach along edges (src, dst), which may repeat; of several parents, the least.

    A frontier that is small when counted is brought to the edges, a large one meets them by a shuffle.
    allowed: a condition on dst that every step must meet; starts aren't asked.  blocked gives the edges (src, dst)
    from some nodes (src) that aren't taken; it is asked for a frontier's nodes alone.
    """
    steps = edges.select("src", "dst")
    if allowed is not None:
        steps = steps.where(allowed)
    seen = checkpoint(starts.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["node"]))
    frontier, n = seen, seen.count()
    total = n
    for level in range(1, depth + 1):
        own = small(frontier.select("node"), n)
        found = steps.join(own, own.node == steps.src).select("src", "dst")
        if blocked is not None:
            found = found.distinct().join(blocked(small(frontier.select(F.col("node").alias("src")), n)).select("src", "dst"), ["src", "dst"], "left_anti")
        found = found.groupBy("dst").agg(F.min("src").alias("parent"))
        found = found.select(F.col("dst").alias("node"), F.lit(level).alias("depth"), "parent").join(small(seen.select("node"), total), "node", "left_anti")
        frontier = checkpoint(found.select("node", "depth", "parent"))
        n = frontier.count()
        if not n:
            break
        seen, total = seen.unionAll(frontier), total + n
    return seen


def paths(reached: DataFrame, depth: int) -> DataFrame:
    """(node, depth, path from its start), following parents."""
    up = reached.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    df = reached.select("node", "depth", F.col("parent").alias("at"), F.array("node").alias("path"))
    for _ in range(depth):
        df = df.join(up, F.col("at") == F.col("_n"), "left").select("node", "depth", F.col("_p").alias("at"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), F.col("path"))).alias("path"))
    return df.drop("at")


def hops(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """(cause, effect, depth): the edges that a walk crosses, also to nodes it had visited."""
    return reached.where(F.col("depth") < depth).join(edges, F.col("node") == F.col("src")).select(F.col("src").alias("cause"), F.col("dst").alias("effect"), (F.col("depth") + 1).alias("depth")).distinct()


def terminals(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Reached nodes from which no edge goes on, without the starts; few are brought to the edges."""
    found = checkpoint(reached.where("depth > 0").select("node", "depth"))
    n = found.count()
    going = edges.select(F.col("src").alias("node")).join(small(found.select("node"), n), "node", "left_semi").distinct()
    return found.join(small(going, n), "node", "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def solely_supported(support: DataFrame, pruned: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) of support (src, dst, fact), whose rows may repeat, that only pruned facts assert.

    With among, only edges from its src or to its dst, as its column is named; others are dropped before they are grouped.
    All edges are dealt out first, to as many tasks as shuffles have partitions, so that none has many to group.
    """
    marks = support if among is None else support.join(among, among.columns, "left_semi")
    marks = marks.join(pruned.select("fact", F.lit(1).alias("_gone")).distinct(), "fact", "left")
    if among is None:
        marks = marks.select("src", "dst", "_gone").repartition(int(support.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "dst")
    return marks.groupBy("src", "dst").agg(F.min(F.coalesce("_gone", F.lit(0))).alias("cut")).where("cut = 1").select("src", "dst")


def collapsed(edges: DataFrame, support: DataFrame, pruned: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """What starts reach only with the edges that pruned(fact) alone support(src, dst, fact)."""
    left = reach(edges, starts, depth, blocked=lambda nodes: solely_supported(support, pruned, nodes))
    return reach(edges, starts, depth).select("node", "depth").join(left.select("node"), "node", "left_anti")


def closed(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node) and all that aliases (a, b), in either direction, tie to them."""
    both = aliases.select("a", "b").unionAll(aliases.select("b", "a"))
    seen = frontier = checkpoint(nodes.select("node").distinct())
    while True:
        found = frontier.join(both, frontier.node == both.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = checkpoint(found)
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)


def reach_with_aliases(edges: DataFrame, aliases: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what starts reach; same-as ties cost no step."""
    frontier = checkpoint(closed(aliases, starts).withColumn("depth", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        found = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        found = closed(aliases, found).join(seen.select("node"), "node", "left_anti")
        frontier = checkpoint(found.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def budgeted(edges: DataFrame, starts: DataFrame, forward: int, backward: int) -> DataFrame:
    """(node, forward, backward): nodes reached with at most so many steps along and against edges.

    A node is kept with every pair of counts that no other pair of its own undercuts.
    """
    both = edges.select("src", "dst", F.lit(1).alias("f"), F.lit(0).alias("b")).unionAll(edges.select(F.col("dst"), F.col("src"), F.lit(0), F.lit(1)))
    seen = frontier = checkpoint(starts.select("node", F.lit(0).alias("forward"), F.lit(0).alias("backward")).distinct())
    total = n = seen.count()
    for _ in range(forward + backward):
        own = small(frontier, n)
        found = both.join(own, own.node == both.src).select(F.col("dst").alias("node"), (F.col("forward") + F.col("f")).alias("forward"), (F.col("backward") + F.col("b")).alias("backward"))
        found = found.where((F.col("forward") <= forward) & (F.col("backward") <= backward)).distinct()
        frontier = checkpoint(found.join(small(seen, total), ["node", "forward", "backward"], "left_anti"))
        n = frontier.count()
        if not n:
            break
        seen, total = seen.unionAll(frontier), total + n
    worse = seen.alias("x").join(seen.alias("y"), F.expr("x.node = y.node and y.forward <= x.forward and y.backward <= x.backward and (y.forward < x.forward or y.backward < x.backward)"), "left_anti")
    return worse.select("x.*")


def reranked(edges: DataFrame, scores: DataFrame, starts: DataFrame, rounds: int, budget: int) -> DataFrame:
    """(node, round) of a walk that in each round emits the `budget` best scored new nodes and expands these only."""
    both = edges.select("src", "dst").unionAll(edges.select("dst", "src"))
    frontier, seen = checkpoint(starts.select("node").distinct()), None
    for i in range(rounds):
        # scores may be derived from edges, so that a node has its score many times
        best = scores.join(small(frontier, frontier.count()), "node").select("node", "score").distinct().orderBy(F.desc("score"), "node").limit(budget)
        best = checkpoint(best.select("node", F.lit(i).alias("round")))
        seen = best if seen is None else seen.unionAll(best)
        if i + 1 < rounds:
            own = small(best, best.count())
            found = both.join(own, own.node == both.src).select(F.col("dst").alias("node")).distinct()
            frontier = checkpoint(found.join(seen.select("node"), "node", "left_anti"))
    return seen
