"""The fact graph: facts, entities and causal spans, what was said when and where, and the questions asked of them.

Nodes and edges are DataFrames, checkpointed after each write.  A walk is a loop
over levels; its frontier is a DataFrame, joined to the edges once a level.  What
reaches the driver is bounded by top_k, max_results, max_visited or the number of
hops of an answer.

Differences to what one process would do: ties are ordered by content; same_as
ties are followed within a level before it ends; of several facts that assert a
hop the least is cited; reads don't touch last_accessed unless touch() is called.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.functions.models import Embedder, Reranker, canonicaliser
from factweave.functions.vector import cosine
from factweave.operators import ingest, search, store
from factweave.session import checkpoint

MODES = ("embedding", "keyword", "hybrid")
#: Least cosine of a lexical bridge, and within a walk; aliases taken at a dead end, and dead ends bridged in a walk.
BRIDGE, WALK_BRIDGE, FANOUT, BUDGET = 0.45, 0.55, 2, 3


def _set(x) -> list[str] | None:
    return sorted({x} if isinstance(x, str) else set(x)) if x else None


def _quoted(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


class FactGraph:
    """A store of facts with search, walks and causal questions.

    Models are optional (see functions.models): embedder, reranker, conflict resolver (new, old Series -> bool), span
    linker (effect, cause Series -> logits), synthesizer (query, facts) -> text.
    """

    def __init__(
        self, spark: SparkSession, *, embedder=None, reranker=None, forget_after: int = 30, forget_every: dt.timedelta | None = None, synthesizer: Callable | None = None,
        extractor: Callable[[Column], Column] | None = None, causal_extractor: Callable[[Column], Column] | bool | None = None, isolate: bool = False, conflict_resolver: Callable | None = None,
        canonicalizer=None, link_contained: bool = False, span_linker: Callable | None = None, span_link_logit: float = -2.2, span_link_floor: float | None = None, span_link_top_k: int = 6,
        span_link_threshold: float | None = None, back_references: bool = False, max_degree: int = 64, splitter: Callable[[Column], Column] | None = None, dimension: int = 64, clock: Callable[[], dt.datetime] | None = None,
    ):
        self.spark = spark
        self.embedder = embedder if isinstance(embedder, Embedder) else Embedder(embedder, dimension)
        self.reranker = reranker if isinstance(reranker, Reranker) else Reranker(reranker, self.embedder)
        self.forget_after, self.forget_every, self.last_swept = forget_after, forget_every, None
        self.synthesizer, self.extractor, self.causal_extractor = synthesizer, extractor or X.capitalised, causal_extractor
        self.isolate, self.resolver, self.canonicalizer = isolate, conflict_resolver, canonicalizer
        self.link_contained, self.back_references, self.max_degree, self.splitter = link_contained, back_references, max_degree, splitter
        self.span_linker, self.span_link_logit, self.span_link_floor = span_linker, span_link_logit, span_link_floor
        self.span_link_top_k, self.span_link_threshold = span_link_top_k, span_link_threshold
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.nodes, self.edges = spark.createDataFrame([], store.NODES), spark.createDataFrame([], store.EDGES)

        self.held: dict | None = None

    # tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> FactGraph:
        """The graph saved in a folder."""
        from factweave.sources.graph import read_parquet

        return cls(spark, **how).load(*read_parquet(spark, path))

    def save(self, path: str) -> None:
        from factweave.sources.graph import write_parquet

        write_parquet(self.nodes, self.edges, path)

    def __enter__(self) -> FactGraph:
        return self

    def __exit__(self, *_) -> None:
        self.nodes, self.edges = self.nodes.limit(0), self.edges.limit(0)

    @contextmanager
    def request_cache(self):
        """Within it, what was looked up of a content, or not found, is not looked up again; writes empty it."""
        outer, self.held = self.held, self.held if self.held is not None else {}
        try:
            yield self
        finally:
            self.held = outer

    def load_dataset(self, name: str, scopes=None) -> None:
        """Adds a built-in data set; ValueError for a name that there is none of."""
        from factweave.sources.graph import load_dataset

        nodes, edges = load_dataset(self.spark, name)
        self.add_nodes(nodes, scopes)
        self.add_edges(edges.withColumn("label", F.lit(None).cast("string")))

    def load(self, nodes: DataFrame, edges: DataFrame) -> FactGraph:
        """Takes tables as they are; missing columns are null."""
        kinds = dict(x.rsplit(" ", 1) for x in store.NODES.split(", "))
        self.nodes = checkpoint(nodes.select(*((F.col(c) if c in nodes.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds)).withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>"))))
        self.edges = checkpoint(edges.select("src", "dst", (F.col("label") if "label" in edges.columns else F.lit(None)).cast("string").alias("label")))
        return self

    def _commit(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        nodes, edges = (None if x is None else checkpoint(x) for x in (nodes, edges))
        if self.held is not None:
            self.held.clear()
        self.nodes, self.edges = nodes if nodes is not None else self.nodes, edges if edges is not None else self.edges

    def _now(self) -> Column:
        return F.lit(self.clock().isoformat(" ")).cast("timestamp")

    def _rows(self, contents: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(c,) for c in dict.fromkeys(contents)], "content string")

    # writes

    def add_nodes(self, rows, scopes=None) -> None:
        """rows: (content, type) pairs, or a DataFrame with these, maybe scopes and seq."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(rows)], "content string, type string, seq long")
        if "scopes" not in df.columns:
            df = df.withColumn("scopes", _quoted(_set(scopes) or []))
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0))
        df = df.withColumns({"embedding": self.embedder.column(F.col("content")), "created_at": self._now()})
        self._commit(store.insert_nodes(self.nodes, df, self._now()))

    def add_edges(self, rows) -> None:
        """rows: (src, dst[, label]), or a DataFrame with these and maybe seq; ends must be nodes."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([(*r, *[None] * (3 - len(r)), i) for i, r in enumerate(rows)], "src string, dst string, label string, seq long")
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0))
        self._commit(edges=store.insert_edges(self.edges, df, self.nodes))

    def add_text(self, text: str, **how) -> list[str]:
        return self.add_texts([text], **how)[0]

    def add_texts(
        self, texts, *, extractor=None, causal_extractor=None, scopes=None, causal: bool | None = None, dedup_threshold: float | None = None, dedup_scopes=None, dedup_entity_gate: bool = False,
        resolve_conflicts: bool | None = None, canonicalizer=None, split: bool | None = None,
    ):
        """Adds facts with all that is said in them.

        texts: a list, for which each one's entities are returned (none for a duplicate), or a DataFrame (seq, text[,
        scopes]), for which a DataFrame (seq, entities) is.
        """
        listed = not isinstance(texts, DataFrame)
        df = self.spark.createDataFrame(list(enumerate(texts)), "seq long, text string") if listed else texts
        if "scopes" not in df.columns:
            df = df.withColumn("scopes", _quoted(_set(scopes) or []))
        df = df.select(F.col("seq").cast("long").alias("seq"), "text", "scopes", F.col("seq").cast("long").alias("input"))
        if self.splitter is not None if split is None else split:
            df = ingest.split(df, self.splitter or X.sentences).select("seq", "text", "scopes", "input")
        df = checkpoint(df)
        extract = extractor or self.extractor
        name = canonicaliser(canonicalizer if canonicalizer is not None else self.canonicalizer)
        model = causal_extractor or (self.causal_extractor if callable(self.causal_extractor) else None)
        with_causal = causal if causal is not None else self.causal_extractor is not False
        active = df
        if dedup_threshold is not None:
            twins = checkpoint(self._duplicates(df, dedup_threshold, _set(dedup_scopes), extract if dedup_entity_gate else None, name))
            kept = twins.groupBy("twin").agg(F.array_distinct(F.flatten(F.collect_list("scopes"))).alias("scopes"))
            kept = kept.where("size(scopes) > 0").select(F.col("twin").alias("content"), F.lit("text").alias("type"), "scopes")
            active = checkpoint(df.join(twins.select("seq"), "seq", "left_anti"))
            if not kept.isEmpty():
                self.add_nodes(kept)
        known = self.nodes.where("type = 'entity'") if self.link_contained else None
        nodes, edges = ingest.plan(active.select("seq", "text", "scopes"), extract, name, model, known, self.back_references, with_causal=bool(with_causal))
        edges = checkpoint(edges)
        self.add_nodes(nodes)
        self.add_edges(edges)
        if self.span_link_threshold is not None:
            self._link_spans(edges.where("label = 'causes'"))
        if self.resolver is not None and resolve_conflicts is not False:
            self._resolve_conflicts(active)
        elif resolve_conflicts:
            raise ValueError("conflicts can't be resolved without a conflict resolver")
        found = ingest.entities(active.select("seq", "text", "scopes"), extract, name).join(active.select("seq", "input"), "seq")
        first = found.groupBy("input", "entity").agg(F.min(F.struct("seq", "place")).alias("at"))
        lists = first.groupBy("input").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("entities"))
        if not listed:
            return df.select("input").distinct().join(lists, "input", "left").select(F.col("input").alias("seq"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))
        held = {r["input"]: list(r["entities"]) for r in lists.collect()}
        return [held.get(i, []) for i in range(len(texts))]

    def _candidates(self, rows: DataFrame, k: int, scopes_of_row: bool, where: Column | None = None, scopes=None) -> DataFrame:
        """(query, content, score, type): the k nearest other nodes of each row (query[, scopes])."""
        nodes = self.nodes.select("content", "type", "embedding", "scopes", "invalid_at")
        if scopes:
            nodes = store.chosen(nodes, scopes=scopes)
        if where is not None:
            nodes = nodes.where(where)
        asked = rows.dropDuplicates(["query"]).withColumn("embedding", self.embedder.column(F.col("query")))
        if not scopes_of_row:
            found = search.knn_join(asked.select("query", "embedding"), nodes, k)
            return found.join(nodes.select("content", "type"), "content").select("query", "content", "score", "type")
        # a row's own scopes confine it: searched scope by scope, then ranked over its scopes
        by_scope = asked.select("query", "embedding", F.explode("scopes").alias("scope"))
        held = nodes.select("content", "embedding", F.explode("scopes").alias("scope"))
        found = search.knn_join(by_scope, held, k, by="scope").dropDuplicates(["query", "content"])
        free = asked.where("size(scopes) = 0").select("query", "embedding")
        found = found.select("query", "content", "score").unionByName(search.knn_join(free, nodes, k).select("query", "content", "score"))
        w = Window.partitionBy("query").orderBy(F.desc("score"), "content")
        return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).join(nodes.select("content", "type"), "content").select("query", "content", "score", "type")

    def _duplicates(self, texts: DataFrame, threshold: float, scopes, gate, name) -> DataFrame:
        """(seq, scopes, twin): the nearest other fact of each text, if near enough and, with gate, linked to all its entities."""
        near = self._candidates(texts.select(F.col("text").alias("query")), 5, False, scopes=scopes).where("type = 'text'")
        best = near.groupBy("query").agg(F.max_by("content", F.struct("score", "content")).alias("twin"), F.max("score").alias("score")).where(F.col("score") >= threshold)
        found = texts.join(best, texts.text == best.query).select("seq", "text", "scopes", "twin")
        if gate is None:
            return found.select("seq", "scopes", "twin")
        ends = self.edges.select(F.col("src").alias("entity"), F.col("dst").alias("twin")).unionAll(self.edges.select("dst", "src"))
        asked = ingest.entities(found.select("seq", "text", "scopes"), gate, name).select("seq", "entity").join(found.select("seq", "twin"), "seq")
        missing = asked.join(ends.distinct(), ["entity", "twin"], "left_anti").select("seq").distinct()
        return found.join(missing, "seq", "left_anti").select("seq", "scopes", "twin")

    def _roles(self) -> DataFrame:
        """(content, role) of the ends of causes edges."""
        c = self.edges.where("label = 'causes'")
        return c.select(F.col("src").alias("content"), F.lit("cause").alias("role")).unionAll(c.select("dst", F.lit("effect"))).distinct()

    def _link_spans(self, said: DataFrame) -> None:
        """Ties each new span to near ones of other relations; with a span linker, only effects to causes."""
        mine = said.select(F.col("src").alias("query"), F.lit("cause").alias("own")).unionAll(said.select("dst", F.lit("effect"))).distinct()
        near = self._candidates(mine.select("query"), self.span_link_top_k, False).where("type = 'entity'")
        pairs = near.join(self._roles(), "content")
        if self.span_linker is None:
            ties = pairs.where(F.col("score") >= self.span_link_threshold).select("query", "content")
        else:
            linker = self.span_linker

            @F.pandas_udf("double")
            def logit(effect: pd.Series, cause: pd.Series) -> pd.Series:
                return pd.Series(linker(effect, cause), dtype=float)

            # the linker's scores are logits and cut at span_link_logit; with a floor they are cosines and cut at the threshold
            across = pairs.join(mine, "query").where("own <> role").select("query", "content", "score", F.when(F.col("own") == "effect", F.col("query")).otherwise(F.col("content")).alias("effect"), F.when(F.col("own") == "effect", F.col("content")).otherwise(F.col("query")).alias("cause"))
            scored = across.withColumn("link", logit("effect", "cause"))
            if self.span_link_floor is None:
                ties = scored.where(F.col("link") >= self.span_link_logit).select("query", "content")
            else:
                ties = scored.where((F.col("score") >= self.span_link_floor) & (F.col("link") >= self.span_link_threshold)).select("query", "content")
                ties = ties.unionAll(pairs.where(F.col("score") >= self.span_link_threshold).select("query", "content"))
        ties = ties.select(F.least("query", "content").alias("src"), F.greatest("query", "content").alias("dst"), F.lit("same_as").alias("label")).distinct()
        held = self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        self.add_edges(ties.join(held, ["src", "dst"], "left_anti"))

    def _resolve_conflicts(self, texts: DataFrame, k: int = 10) -> None:
        """Retires the facts, of those that share a scope with it, that a new one contradicts."""
        resolver = self.resolver

        @F.pandas_udf("boolean")
        def contradicts(new: pd.Series, old: pd.Series) -> pd.Series:
            return pd.Series(resolver(new, old), dtype=bool)

        new = texts.select(F.col("text").alias("query"), "scopes")
        near = self._candidates(new, k, True).where("type = 'text'")
        near = near.join(texts.select(F.col("text").alias("content")), "content", "left_anti").join(self.nodes.where("invalid_at is not null").select("content"), "content", "left_anti")
        over = checkpoint(near.where(contradicts("query", "content")).select(F.col("query").alias("src"), F.col("content").alias("dst"), F.lit("supersedes").alias("label")))
        if not over.isEmpty():
            self.add_edges(over)
            self._commit(store.set_invalid(self.nodes, over.select(F.col("dst").alias("content")), self._now()))

    def delete(self, content: str, purge_orphans: bool = False) -> bool:
        return self._delete(self._rows([content]), purge_orphans) > 0

    def _delete(self, keys: DataFrame, purge: bool) -> int:
        n = store.lookup(self.nodes, keys).count()
        if n:
            suspects = store.neighbours_of(self.edges, keys)
            nodes, edges = store.delete_nodes(self.nodes, self.edges, keys)
            if purge:
                nodes, edges, _ = store.purge_orphans(nodes, edges, suspects)
            self._commit(nodes, edges)
        return n

    def delete_stale(self, days: int | None = None) -> int:
        """Deletes what was last accessed before so many days; how many."""
        gone = checkpoint(store.stale(self.nodes, self._now(), self.forget_after if days is None else days).select("content"))
        n = gone.count()
        if n:
            self._commit(*store.delete_nodes(self.nodes, self.edges, gone))
        return n

    def maybe_forget(self) -> int:
        """delete_stale, at most once in forget_every; 0 otherwise."""
        now = self.clock()
        if self.forget_every is None or (self.last_swept is not None and now - self.last_swept < self.forget_every):
            return 0
        self.last_swept = now
        return self.delete_stale()

    def forget(self, scopes, purge_orphans: bool = True) -> dict[str, int]:
        """Deletes the nodes that have no other scope, takes the scopes from the rest."""
        scopes = _set(scopes)
        if not scopes:
            return {"deleted": 0, "detached": 0}
        marks = checkpoint(store.forget(store.node_scopes(self.nodes), scopes))
        gone = self.nodes.join(marks.where("deleted"), "content", "left_semi").select("content", "type")
        facts, deleted = checkpoint(gone.where("type = 'text'").select("content")), 0
        deleted += self._delete(facts, purge_orphans)
        deleted += self._delete(checkpoint(store.lookup(self.nodes, gone.where("type <> 'text'"))), purge_orphans)
        detached = checkpoint(store.lookup(self.nodes, marks.where("not deleted")))
        n = detached.count()
        self._commit(store.remove_scopes(self.nodes, detached, scopes)[0])
        return {"deleted": deleted, "detached": n}

    def remove_scopes(self, contents, scopes) -> int:
        nodes, removed = store.remove_scopes(self.nodes, self._rows(contents), _set(scopes) or [])
        n = removed.count()
        self._commit(nodes)
        return n

    def set_invalid(self, contents, when: dt.datetime | None = None) -> None:
        self._commit(store.set_invalid(self.nodes, self._rows(contents), self._now() if when is None else F.lit(when.isoformat(" ")).cast("timestamp")))

    def touch(self, contents) -> None:
        self._commit(store.touch(self.nodes, self._rows(contents), self._now()))

    def supersede(self, old: str, new: str, extractor=None, purge_orphans: bool = False) -> list[str]:
        """Replaces a fact, keeping its scopes; the same text again is a new assertion of it."""
        held = store.lookup(self.nodes, self._rows([old]), "scopes").first()
        out = self.add_text(new, extractor=extractor, scopes=list(held["scopes"]) if held else None)
        if new != old:
            self.delete(old, purge_orphans)
        return out

    # lookups

    def history(self, content: str) -> dict[str, list[str]]:
        r = store.supersession(self.edges, self._rows([content])).first()
        return {"supersedes": list(r["supersedes"]), "superseded_by": list(r["superseded_by"])}

    def superseded(self, contents) -> list[str]:
        found = store.lookup(self.nodes.where("invalid_at is not null"), self._rows(contents))
        return sorted(r["content"] for r in found.collect())

    def lookup(self, contents, column: str) -> dict:
        """content -> created_at, invalid_at, type or scopes of those that exist."""
        contents = list(dict.fromkeys(contents))
        memo = self.held.setdefault(column, {}) if self.held is not None else {}
        asked = [c for c in contents if c not in memo]
        if asked:
            found = {r["content"]: r[1] for r in store.lookup(self.nodes, self._rows(asked), column).collect()}
            memo.update({c: (c in found, found.get(c)) for c in asked})
        return {c: memo[c][1] for c in contents if memo[c][0]}

    def relations(self, facts: DataFrame) -> DataFrame:
        """(fact, cause, effect) of facts(content): only their own edges are joined."""
        own = self.edges.where("label is null").join(facts.select(F.col("content").alias("dst")).distinct(), "dst", "left_semi")
        ends = own.select(F.col("src").alias("cause")).unionAll(own.select("src")).distinct()
        said = self.edges.where("label = 'causes'").join(ends, F.col("src") == F.col("cause"), "left_semi")
        return store.causal_relations(own.unionByName(said))

    def _relations(self, fact: str) -> list[tuple[str, str]]:
        return sorted((r["cause"], r["effect"]) for r in self.relations(self._rows([fact])).collect())

    # search

    def seeds(self, query: str, k: int, mode: str = "embedding", scopes=None, rrf_k: int = 60) -> DataFrame:
        """(content, type, score, seq): the k best hits."""
        if mode not in MODES:
            raise ValueError(f"search mode must be one of {', '.join(MODES)}, not {mode}")
        nodes = store.chosen(self.nodes, scopes=_set(scopes))
        score = cosine(F.col("embedding"), F.array(*map(F.lit, self.embedder.one(query, True))))
        near = nodes.select("content", F.round(score, 6).alias("score"))
        if mode == "embedding":
            found = near.orderBy(F.desc("score"), "content").limit(k)
        else:
            words = [w for w in dict.fromkeys(r for r in self._words(query))]
            hits = search.fuzzy_keyword(nodes.select("content", F.col("content").alias("text")), words, None)
            if mode == "keyword":
                found = hits.orderBy(F.desc("score"), "content").limit(k)
            else:
                found = search.fuse(near, hits, rrf_k).orderBy(F.desc("score"), "content").limit(k)
        w = Window.orderBy(F.desc("score"), "content")  # over k rows
        return found.join(nodes.select("content", "type"), "content").withColumn("seq", F.row_number().over(w))

    def _words(self, query: str) -> list[str]:
        return self.spark.range(1).select(X.words(F.lit(query)).alias("w")).first()["w"]

    def resolve(self, text: str, scopes=None) -> str | None:
        """The fact with this text, or else the nearest fact of the five nearest nodes."""
        nodes = store.chosen(self.nodes, "text", _set(scopes))
        if nodes.where(F.col("content") == text).limit(1).count():
            return text
        hit = self.seeds(text, 5, scopes=scopes).where("type = 'text'").orderBy("seq").first()
        return hit["content"] if hit else None

    def _neighbours(self, frontier: DataFrame, walk_scopes, query: str | None) -> DataFrame:
        """(src, nbr, type, label, direction, rank) of frontier(content): the max_degree nearest to the query of each."""
        keys = frontier.select(F.col("content").alias("src")).distinct()
        out = self.edges.join(keys, "src", "left_semi").select("src", F.col("dst").alias("nbr"), "label", F.lit("out").alias("direction"))
        back = self.edges.where("src <> dst").join(keys.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("nbr"), "label", F.lit("in").alias("direction"))
        w = Window.partitionBy("src", "nbr").orderBy(F.col("label").isNull(), F.desc("direction"), "label")
        pairs = out.unionAll(back).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        nodes = store.chosen(self.nodes, scopes=walk_scopes)
        score = F.lit(0.0) if query is None else cosine(F.col("embedding"), F.array(*map(F.lit, self.embedder.one(query, True))))
        near = pairs.join(nodes.select(F.col("content").alias("nbr"), "type", F.round(score, 6).alias("near")), "nbr")
        w = Window.partitionBy("src").orderBy(F.desc("near"), "nbr")
        ranked = near.withColumn("rank", F.row_number().over(w))
        return ranked if query is None else ranked.where(F.col("rank") <= self.max_degree)

    def neighbours(self, content: str, scopes=None) -> list[dict]:
        found = self._neighbours(self._rows([content]), _set(scopes), None).orderBy("nbr")
        return [{"content": r["nbr"], "type": r["type"], "label": r["label"], "direction": r["direction"]} for r in found.collect()]

    def rerank(self, query: str, hits: DataFrame, k: int | None = None, recency: float = 0.0) -> DataFrame:
        """hits (content, seq), each content once, in order of relevance, with score; blended with recency if asked."""
        own = hits.groupBy("content").agg(F.min("seq").alias("seq")).join(self.nodes.select("content", "embedding", "created_at"), "content")
        own = own.withColumn("score", self.reranker.column(query, F.col("content"), F.col("embedding")))
        if recency > 0:
            mixed = search.blend(own.select("content", "score", F.col("created_at").cast("double").alias("ts")), recency)
            own = own.drop("score").join(mixed, "content")
        out = own.select("content", "seq", "score").orderBy(F.desc("score"), "seq", "content")
        return out if k is None else out.limit(k)

    def _walk_scopes(self, scopes, isolate, walk_scopes) -> list[str] | None:
        if walk_scopes:
            return _set(walk_scopes)
        return _set(scopes) if scopes and (self.isolate if isolate is None else isolate) else None

    def _current(self, contents: DataFrame, include_superseded: bool, as_of: dt.datetime | None = None) -> DataFrame:
        """contents valid at as_of, or, with a resolver, not retired."""
        if as_of is not None:
            at = as_of.astimezone(dt.UTC).replace(tzinfo=None) if as_of.tzinfo else as_of
            good = store.valid_at(self.nodes, F.lit(at.isoformat(" ")).cast("timestamp"))
            return contents.join(good.select("content"), "content", "left_semi")
        if include_superseded or self.resolver is None:
            return contents
        return contents.join(self.nodes.where("invalid_at is not null").select("content"), "content", "left_anti")

    # walks

    def query(
        self, query: str, *, top_k: int = 5, hops: int = 4, rerank_top_k: int = 4, search_mode: str = "embedding", rrf_k: int = 60, recency_weight: float = 0.0, scopes=None, isolate: bool | None = None,
        include_superseded: bool = False, as_of: dt.datetime | None = None, walk_scopes=None,
    ) -> list[str]:
        """Facts by a walk that each hop emits and expands the best rerank_top_k; entities are passed through for free.

        Facts that follow from facts come before those found through entities.
        """
        if not 0 <= recency_weight <= 1:
            raise ValueError("recency_weight must be between 0 and 1")
        within = self._walk_scopes(scopes, isolate, walk_scopes)
        pool = checkpoint(self.seeds(query, top_k, search_mode, scopes, rrf_k).select("content", "type", F.lit(0).alias("bridge"), "seq"))
        seen: DataFrame | None = None
        for hop in range(hops):
            texts = pool.where("type = 'text'").groupBy("content").agg(F.min("bridge").alias("bridge"), F.min("seq").alias("seq"))
            ranked = self.rerank(query, texts, None, recency_weight).join(texts.select("content", "bridge"), "content")
            best = ranked.orderBy("bridge", F.desc("score"), "seq", "content").limit(rerank_top_k)
            w = Window.orderBy("bridge", F.desc("score"), "seq", "content")  # over rerank_top_k rows
            mine = best.select("content", F.lit("text").alias("type"), F.row_number().over(w).cast("long").alias("turn"))
            free = pool.where("type <> 'text'").groupBy("content").agg(F.lit("entity").alias("type"), (F.min("seq").cast("long") + rerank_top_k).alias("turn"))
            new = mine.unionByName(free)
            if seen is not None:
                new = new.join(seen.select("content"), "content", "left_anti")
            new = checkpoint(new.withColumn("hop", F.lit(hop)))
            seen = new if seen is None else seen.unionByName(new)
            if hop == hops - 1 or new.isEmpty():
                break
            near = self._neighbours(new, within, query).join(new.select(F.col("content").alias("src"), F.col("type").alias("own"), "turn"), "src")
            # a neighbour that had its turn before stays out
            before = seen.select(F.col("content").alias("nbr"), F.when(F.col("hop") == hop, F.col("turn")).otherwise(F.lit(0)).alias("had"))
            near = near.join(before, "nbr", "left").where("had is null or had > turn")
            pool = checkpoint(near.select(F.col("nbr").alias("content"), "type", (F.col("own") != "text").cast("int").alias("bridge"), (F.col("turn") * (self.max_degree + 1) + F.col("rank")).alias("seq")))
        if seen is None:
            return []
        texts = self._current(seen.where("type = 'text'"), include_superseded, as_of)
        return [r["content"] for r in texts.orderBy("hop", "turn").collect()]  # at most hops * rerank_top_k

    def query_detailed(self, query: str, **how) -> list[dict]:
        """query's facts with score, created_at and scopes."""
        texts = self.query(query, **how)
        if not texts:
            return []
        held = {r["content"]: r for r in store.lookup(self.nodes, self._rows(texts), "created_at", "scopes").collect()}
        scores = self.embedder.score(query, texts)
        return [{"content": t, "score": s, "created_at": held[t]["created_at"], "scopes": sorted(held[t]["scopes"])} for t, s in zip(texts, scores, strict=True)]

    def discover(
        self, query: str, *, top_k: int = 5, hops: int = 4, search_mode: str = "embedding", rrf_k: int = 60, scopes=None, max_results: int = 10, max_visited: int = 1000, isolate: bool | None = None,
        include_superseded: bool = False, walk_scopes=None, causal_hops: tuple[int | None, int | None] | None = None,
    ) -> list[dict]:
        """Facts connected to the query's, each with the path of facts and entities that leads to it."""
        within = self._walk_scopes(scopes, isolate, walk_scopes)
        own = _set(scopes)
        seeds = self.seeds(query, max(4 * top_k, 20), search_mode, scopes, rrf_k).where("type = 'text'").orderBy("seq").limit(top_k)
        step = "struct<content:string,entity:string>"
        as_step = lambda content, entity: F.struct(content.alias("content"), entity.alias("entity")).cast(step)
        none = F.lit(None).cast("string")
        w = Window.orderBy("seq")  # over top_k rows
        state = seeds.select("content", "type", F.lit(0).alias("depth"), F.row_number().over(w).cast("long").alias("order"), F.lit(0).alias("fwd"), F.lit(0).alias("back"), F.array(as_step(F.col("content"), none)).alias("path"))
        level = seen = checkpoint(state)
        count = seen.count()
        for depth in range(1, hops + 1):
            if count >= max_visited:
                break
            near = self._neighbours(level, within, query).join(level.select(F.col("content").alias("src"), F.col("type").alias("own"), "order", "fwd", "back", "path"), "src")
            if causal_hops:
                ahead, behind = causal_hops
                causes = F.coalesce(F.col("label") == "causes", F.lit(False))
                near = near.withColumns({"fwd": F.col("fwd") + (causes & (F.col("direction") == "out")).cast("int"), "back": F.col("back") + (causes & (F.col("direction") == "in")).cast("int")})
                near = near.where((F.lit(ahead is None) | (F.col("fwd") <= F.lit(ahead if ahead is not None else 0))) & (F.lit(behind is None) | (F.col("back") <= F.lit(behind if behind is not None else 0))))
            new = near.join(seen.select(F.col("content").alias("nbr")), "nbr", "left_anti")
            first = Window.partitionBy("nbr").orderBy("order", "rank")
            new = new.withColumn("n", F.row_number().over(first)).where("n = 1").orderBy("order", "rank").limit(max_visited - count)
            turn = Window.orderBy("order", "rank")  # over max_visited rows
            through = F.when(F.col("own") == "text", F.col("path")).otherwise(F.concat("path", F.array(as_step(none, F.col("src")))))
            path = F.when(F.col("type") != "text", F.col("path")).otherwise(F.concat(through, F.array(as_step(F.col("nbr"), none))))
            level = checkpoint(new.select(F.col("nbr").alias("content"), "type", F.lit(depth).alias("depth"), (F.lit(count) + F.row_number().over(turn)).cast("long").alias("order"), "fwd", "back", path.alias("path")))
            n = level.count()
            if not n:
                break
            seen, count = seen.unionByName(level), count + n
        facts = self._current(seen.where("type = 'text'").select("content", "order", "path"), include_superseded)
        facts = checkpoint(facts)
        if facts.count() > max_results:
            kept = self.rerank(query, facts.select("content", F.col("order").alias("seq")), max_results)
            turn = Window.orderBy(F.desc("score"), "seq")  # over max_results rows
            facts = facts.drop("order").join(kept.withColumn("order", F.row_number().over(turn)).select("content", "order"), "content")
        rows = facts.orderBy("order").collect()  # at most max_results
        on_paths = [s["content"] for r in rows for s in r["path"] if s["content"]]
        held = self.lookup(on_paths, "scopes") if rows else {}
        causes: dict[str, list[dict]] = {}
        if rows:
            for r in self.relations(self._rows([r["content"] for r in rows])).orderBy("fact", "cause", "effect").collect():
                causes.setdefault(r["fact"], []).append({"cause": r["cause"], "effect": r["effect"]})
        return [
            {
                "content": r["content"], "scopes": sorted(held.get(r["content"], [])), "cross_session": bool(own) and not set(held.get(r["content"], [])) & set(own or []), "causes": causes.get(r["content"], []),
                "path": [{"content": s["content"], "scopes": sorted(held.get(s["content"], []))} if s["content"] else {"entity": s["entity"]} for s in r["path"]],
            }
            for r in rows
        ]

    # causal questions

    def bridges(self, text: str, role: str = "cause", *, top_k: int = 15, least: float = BRIDGE, exclude: Iterable[str] = (), scopes=None) -> list[str]:
        """Causal spans of that role near a text that share a content word with it, the nearest first."""
        hits = self.seeds(text, top_k, scopes=scopes).where((F.col("type") == "entity") & (F.col("content") != text) & (F.col("score") >= least))
        hits = hits.where(F.arrays_overlap(X.bridge_tokens(F.col("content")), X.bridge_tokens(F.lit(text))))
        spans = self.edges.where("label = 'causes'").select(F.col("src" if role == "cause" else "dst").alias("content"))
        left = set(exclude)
        return [r["content"] for r in hits.join(spans, "content", "left_semi").orderBy("seq").collect() if r["content"] not in left]

    def reach(self, starts: Iterable[str], direction: str = "out", *, blocked: Iterable[tuple[str, str]] = (), max_depth: int = 6, within=None, max_visited: int = 1000, bridge: bool = False) -> dict:
        """A walk over causes edges: hops (span, other, depth), facts next to the spans, targets and spans that lead on."""
        starts = list(dict.fromkeys(starts))
        if not starts:
            return {"hops": [], "facts": set(), "targets": set(), "has_next": set()}
        cut = self.spark.createDataFrame([tuple(b) for b in blocked], "src string, nbr string")
        visited, hops, facts, has_next, via, left = set(starts), [], set(), set(), {}, BUDGET if bridge else 0
        level, depth = starts, 0
        while level and depth < max_depth and len(visited) <= max_visited:
            # ties first: all wordings of this level's spans
            own, walked, near = list(level), set(level), []
            while own:
                rows = self._neighbours(self._rows(own), within, None).join(cut, ["src", "nbr"], "left_anti").collect()  # the neighbours of at most max_visited spans
                near += rows
                own = sorted({r["nbr"] for r in rows if r["label"] == "same_as"} - visited)[: max(0, max_visited - len(visited))]
                visited |= set(own)
                walked |= set(own)
            tied = {r["src"] for r in near if r["label"] == "same_as"}
            facts |= {r["nbr"] for r in near if r["type"] == "text"}
            found = sorted((r["src"], r["nbr"]) for r in near if r["type"] != "text" and r["label"] == "causes" and r["direction"] == direction)
            for span, other in found:
                hops.append((span, other, depth))
                pending = [span]
                while pending:  # what an alias continues is no end either
                    back = pending.pop()
                    if back not in has_next:
                        has_next.add(back)
                        pending += via.get(back, [])
            following = []
            for _, other in found:
                if other not in visited and len(visited) < max_visited:
                    visited.add(other)
                    following.append(other)
            for span in sorted(walked - {s for s, _ in found} - tied):
                if left <= 0 or depth + 1 >= max_depth:
                    break
                aliases = self.bridges(span, "cause" if direction == "out" else "effect", least=WALK_BRIDGE, scopes=within)
                for alias in aliases:
                    via.setdefault(alias, []).append(span)
                    if alias in has_next:
                        has_next.add(span)
                fresh = [a for a in aliases if a not in visited][:FANOUT]
                left -= bool(fresh)
                visited |= set(fresh)
                following += fresh
            level, depth = following, depth + 1
        return {"hops": hops, "facts": facts, "targets": {o for _, o, _ in hops}, "has_next": has_next}

    def _cited(self, facts: set[str]) -> dict[tuple[str, str], str]:
        """The least fact that asserts each relation."""
        if not facts:
            return {}
        rows = self.relations(self._rows(sorted(facts))).groupBy("cause", "effect").agg(F.min("fact").alias("fact")).collect()
        return {(r["cause"], r["effect"]): r["fact"] for r in rows}

    def trace(self, content: str, direction: str = "effects", *, max_depth: int = 6, scopes=None, isolate: bool | None = None, include_superseded: bool = False, max_visited: int = 1000, walk_scopes=None, bridge: bool = False, extra: Iterable[str] = ()) -> dict:
        """What the fact nearest to content caused, or what caused it: origin, chain of hops, terminals."""
        within, own = self._walk_scopes(scopes, isolate, walk_scopes), set(_set(scopes) or [])
        origin = self.resolve(content, scopes)
        if origin is None:
            return {"origin": None, "chain": [], "terminals": []}
        ahead = direction == "effects"
        starts = [c if ahead else e for c, e in self._relations(origin)] + list(extra)
        if not starts and bridge:
            starts = self.bridges(origin, "cause" if ahead else "effect", scopes=within)[:FANOUT]
        found = self.reach(starts, "out" if ahead else "in", max_depth=max_depth, within=within, max_visited=max_visited, bridge=bridge)
        cited = self._cited(found["facts"])
        pairs = [((s, o) if ahead else (o, s), d) for s, o, d in found["hops"]]
        present = {cited[p] for p, _ in pairs if p in cited}
        retired = set(self.superseded(present)) if present and self.resolver is not None and not include_superseded else set()
        held = self.lookup(present, "scopes") if present else {}
        chain = []
        for pair, depth in pairs:
            fact = cited.get(pair)
            if fact not in retired or fact is None:
                places = set(held.get(fact, []))
                chain.append({"cause": pair[0], "effect": pair[1], "fact": fact, "depth": depth, "scopes": sorted(places), "cross_session": bool(own) and not places & own})
        return {"origin": origin, "chain": chain, "terminals": sorted(found["targets"] - found["has_next"])}

    def trace_effects(self, content: str, **how) -> dict:
        return self.trace(content, "effects", **how)

    def trace_causes(self, content: str, **how) -> dict:
        return self.trace(content, "causes", **how)

    def root_causes(self, content: str, **how) -> list[str]:
        return self.trace_causes(content, **how)["terminals"]

    def causal_chain(self, start: str, target: str, *, scopes=None, **how) -> list[dict] | None:
        """The hops, in order of the walk, from one fact up to the first that arrives at another; None if none does."""
        goal = self.resolve(target, scopes)
        if goal is None:
            return None
        said = self._relations(goal)
        spans = {s for pair in said for s in pair}
        ends = {e for _, e in said}
        names = [n["content"] for n in self.neighbours(goal) if n["type"] == "entity" and len(n["content"]) >= 3 and n["content"] not in spans]
        origin = self.resolve(start, scopes)
        if origin is None or not spans and not names:
            return None
        own = {s for pair in self._relations(origin) for s in pair}
        traced = self.trace_effects(origin, scopes=scopes, bridge=True, extra=self.bridges(origin, exclude=own), **how)
        tied = set(ends)
        if ends:
            same = self.edges.where("label = 'same_as'")
            both = same.select("src", "dst").unionAll(same.select("dst", "src"))
            tied |= {r["dst"] for r in both.join(self._rows(ends).withColumnRenamed("content", "src"), "src", "left_semi").collect()}
        for i, hop in enumerate(traced["chain"]):
            if hop["fact"] == goal or hop["effect"] in tied or any(n.lower() in hop["effect"].lower() for n in names):
                return traced["chain"][: i + 1]
        return None

    def what_if(self, content: str, *, origin: str | None = None, direction: str = "effects", max_depth: int = 6, scopes=None, isolate: bool | None = None, include_superseded: bool = False, max_visited: int = 1000, walk_scopes=None) -> dict:
        """What loses all causal support if the fact nearest to content were false; what it threatens and other facts still support."""
        within, own = self._walk_scopes(scopes, isolate, walk_scopes), set(_set(scopes) or [])
        out = {"pruned": None, "origin": None, "pruned_edges": [], "collapsed": [], "survived": []}
        pruned = self.resolve(content, scopes)
        start = pruned if origin is None else self.resolve(origin, scopes)
        out |= {"pruned": pruned, "origin": start if pruned else None}
        if pruned is None or start is None:
            return out
        ahead = direction == "effects"
        turn = lambda pair: pair if ahead else pair[::-1]
        said = self._relations(pruned)
        starts = [turn(p)[0] for p in self._relations(start)]
        walk = lambda blocked: self.reach(starts, "out" if ahead else "in", blocked=blocked, max_depth=max_depth, within=within, max_visited=max_visited)
        base = walk(())
        if not said:
            return out
        near = self._neighbours(self._rows({s for p in said for s in p}), within, None).where("type = 'text'").select(F.col("nbr").alias("content")).distinct()
        live = self._current(near.unionByName(self._rows([pruned])).distinct(), include_superseded)
        support = self.relations(live).where(F.col("fact") != pruned).select("cause", "effect").distinct()
        others = {(r["cause"], r["effect"]) for r in support.join(self.spark.createDataFrame(said, "cause string, effect string"), ["cause", "effect"]).collect()}
        cut = sorted(turn(p) for p in said if p not in others)
        if not cut:
            return out
        after = walk(cut)
        out["pruned_edges"] = [dict(zip(("cause", "effect"), turn(p), strict=True)) for p in cut]
        out["survived"] = sorted({o for _, o in cut} & after["targets"])
        cited, lost = self._cited(base["facts"]), base["targets"] - after["targets"]
        first: dict[str, tuple] = {}
        for s, o, d in base["hops"]:
            if o in lost and (o not in first or d < first[o][1]):
                first[o] = (cited.get(turn((s, o))), d)
        held = self.lookup({f for f, _ in first.values() if f}, "scopes") if any(f for f, _ in first.values()) else {}
        for span in sorted(lost):
            fact, depth = first[span]
            places = set(held.get(fact, []))
            out["collapsed"].append({"span": span, "fact": fact, "depth": depth, "scopes": sorted(places), "cross_session": bool(own) and not places & own})
        return out

    def answer(self, query: str, *, use_discover: bool = True, top_k: int = 5, hops: int = 4, search_mode: str = "embedding", scopes=None, max_results: int = 10, walk_scopes=None) -> str:
        """What the synthesizer makes of the facts found."""
        if self.synthesizer is None:
            raise RuntimeError("an answer needs a synthesizer")
        how = {"top_k": top_k, "hops": hops, "search_mode": search_mode, "scopes": scopes, "walk_scopes": walk_scopes}
        found = self.discover(query, max_results=max_results, **how) if use_discover else self.query_detailed(query, **how)
        return self.synthesizer(query, found)
