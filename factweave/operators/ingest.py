"""From texts to nodes and edges, as one plan: sentences, entities, names inside names, relations, back references.

Input is texts(seq, text, scopes); every step is an explode or an equi-join, so a
batch of any size is one distributed job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as X


def split(texts: DataFrame, sentences: Callable[[Column], Column] = X.sentences) -> DataFrame:
    """A row a sentence; its seq is (seq, place), so order and input can be told. A text without sentences stays whole."""
    parts = sentences(F.col("text"))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
    return texts.select(F.col("seq").alias("input"), "scopes", F.posexplode(whole).alias("place", "text")).withColumn("seq", (F.col("input") * 100_000 + F.col("place")).cast("long"))


def entities(texts: DataFrame, extract: Callable[[Column], Column] = X.capitalised, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seq, text, scopes, place, entity): canonical names of each text, each once."""
    found = texts.select("seq", "text", "scopes", F.posexplode(extract(F.col("text"))).alias("place", "entity"))
    if name is not None:
        found = found.withColumn("entity", name(F.col("entity"))).where("length(entity) > 0")
        found = found.groupBy("seq", "entity").agg(F.min("place").alias("place"), F.first("text").alias("text"), F.first("scopes").alias("scopes"))
    return found.select("seq", "text", "scopes", "place", "entity")


def relations(texts: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seq, text, scopes, cause, effect): by default the relation around a text's first connective."""
    if extract is None:
        found = texts.withColumn("r", X.causal_cues(F.col("text"))).where("r is not null").select("seq", "text", "scopes", "r.cause", "r.effect")
    else:
        found = texts.select("seq", "text", "scopes", F.explode(X.relations(extract(F.col("text")))).alias("r")).select("seq", "text", "scopes", "r.*")
    return found.where("length(trim(cause)) > 0 and length(trim(effect)) > 0").withColumns({"cause": F.trim("cause"), "effect": F.trim("effect")})


def hybrid(cues: Callable[[Column], Column], model: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Relations by connectives first, by a model only where there is none."""
    return lambda text: F.when(F.size(F.coalesce(cues(text), F.array())) > 0, cues(text)).otherwise(model(text))


def contained(found: DataFrame, known: DataFrame) -> DataFrame:
    """(entity, other): names that share the first word, one of which is a whole-word beginning of the other.

    Joined by first word and length of the shorter; names of more than four words, under four letters or led by a stop word
    ask for none.
    """
    first = lambda c: F.split_part(F.lower(c), F.lit(" "), F.lit(1))
    asks = found.select("entity").distinct().withColumn("words", F.split(F.lower("entity"), " +"))
    asks = asks.where((F.length("entity") >= 4) & (F.size("words") <= 4) & ~F.col("words")[0].isin(*X.CONTAIN_STOP)).withColumn("head", first("entity"))
    others = known.select(F.col("content").alias("other")).distinct().withColumn("own", F.split(F.lower("other"), " +")).withColumn("head", first("other"))
    n = F.least(F.size("words"), F.size("own"))
    both = asks.join(others, "head").where((F.lower("entity") != F.lower("other")) & (F.slice("words", 1, n) == F.slice("own", 1, n)))
    return both.where(F.least(F.length("entity"), F.length("other")) >= 4).select("entity", "other")


def back_references(texts: DataFrame, caused: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(src, dst): the text before, in order of seq (within by), of one that points back and has no causes edge to it."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("seq")
    pairs = texts.withColumn("before", F.lag("text").over(w)).where(F.col("before").isNotNull() & X.back_referenced_cause(F.col("text")))
    return pairs.join(caused.select(F.col("dst").alias("text")).distinct(), "text", "left_anti").select(F.col("before").alias("src"), F.col("text").alias("dst"))


def plan(texts: DataFrame, extract=X.capitalised, name=None, causal=None, known: DataFrame | None = None, back: bool = False, by: list[str] | None = None, with_causal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes (content, type, scopes, seq), edges (src, dst, label, seq)) that texts ask for.

    In a batch a content is text before it is an entity, as facts come first.
    """
    found = entities(texts, extract, name)
    none = F.lit(None).cast("string")
    nodes = texts.select(F.col("text").alias("content"), F.lit("text").alias("type"), "scopes", (F.col("seq") * 2).alias("seq"))
    nodes = nodes.unionByName(found.select(F.col("entity").alias("content"), F.lit("entity").alias("type"), "scopes", (F.col("seq") * 2 + 1).alias("seq")))
    edges = found.select(F.col("entity").alias("src"), F.col("text").alias("dst"), none.alias("label"), "seq")
    if known is not None:
        names = known.select("content").unionByName(found.select(F.col("entity").alias("content")))
        edges = edges.unionByName(contained(found, names).join(found, "entity").select(F.col("other").alias("src"), F.col("text").alias("dst"), none.alias("label"), "seq"))
    if with_causal:
        said = relations(texts, causal)
        spans = said.select(F.explode(F.array("cause", "effect")).alias("content"), F.lit("entity").alias("type"), "scopes", (F.col("seq") * 2 + 1).alias("seq"))
        nodes = nodes.unionByName(spans)
        cause = said.select(F.col("cause").alias("src"), F.col("effect").alias("dst"), F.lit("causes").alias("label"), "seq")
        ends = said.select(F.explode(F.array("cause", "effect")).alias("src"), F.col("text").alias("dst"), none.alias("label"), "seq")
        edges = edges.unionByName(cause).unionByName(ends)
        if back:
            own = back_references(texts, cause, by)
            edges = edges.unionByName(own.select("src", "dst", F.lit("causes").alias("label"), F.lit(1 << 60).alias("seq")))
    return nodes, edges
