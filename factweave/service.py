"""The verbs that an application offers over a fact graph; see transport for HTTP and agent tools."""

from __future__ import annotations

import datetime as dt
import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.models import template_answer
from factweave.graph import FactGraph
from factweave.operators import store


def parse_time(text: str | None) -> dt.datetime | None:
    """An ISO time, Z allowed; ValueError for anything else."""
    return None if text is None else dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))


def authorised(given: str | None, keys: list[str]) -> bool:
    """Whether a key is one of keys, in constant time; without keys nobody is."""
    return any([hmac.compare_digest((given or "").encode(), k.encode()) for k in keys])


class MemoryService:
    """Sessions of facts. With defer_extraction, push stores the bare fact, and enrich() extracts from what waits."""

    def __init__(self, graph: FactGraph, *, defer_extraction: bool = False, dedup_threshold: float | None = None, split_sentences: bool = False):
        self.graph, self.defer, self.dedup, self.split = graph, defer_extraction, dedup_threshold, split_sentences
        self.graph.synthesizer = self.graph.synthesizer or template_answer
        self.waiting: list[tuple[str, str]] = []

    def push(self, session: str, text: str) -> dict:
        return self.push_many(session, [text])[0]

    def push_many(self, session: str, texts: list[str]) -> list[dict]:
        if self.defer:
            self.graph.add_nodes([(t, "text") for t in texts], scopes={session})
            self.waiting += [(session, t) for t in texts]
            return [{"session": session, "content": t, "entities": [], "deferred": True} for t in texts]
        found = self.graph.add_texts(texts, scopes={session}, dedup_threshold=self.dedup, dedup_scopes={session} if self.dedup else None, split=self.split)
        return [{"session": session, "content": t, "entities": e, "deferred": False} for t, e in zip(texts, found, strict=True)]

    def enrich(self) -> int:
        """Extracts from the facts that wait, all of a session at once; one session's failure leaves the others."""
        waiting, self.waiting, done = self.waiting, [], 0
        for session in dict.fromkeys(s for s, _ in waiting):
            texts = [t for s, t in waiting if s == session]
            try:
                self.graph.add_texts(texts, scopes={session}, split=self.split)
                done += len(texts)
            except Exception:  # noqa: BLE001 - they wait again
                self.waiting += [(session, t) for t in texts]
        return done

    def pending_extractions(self) -> int:
        return len(self.waiting)

    def query(self, query: str, *, sessions=None, top_k: int = 5, hops: int = 4, search_mode: str = "embedding", recency_weight: float = 0.0, as_of: str | None = None, detailed: bool = True, isolate: bool | None = None):
        how = {"top_k": top_k, "hops": hops, "search_mode": search_mode, "recency_weight": recency_weight, "as_of": parse_time(as_of), "scopes": sessions, "isolate": isolate}
        return self.graph.query_detailed(query, **how) if detailed else self.graph.query(query, **how)

    def discover(self, query: str, *, sessions=None, **how) -> list[dict]:
        return self.graph.discover(query, scopes=sessions, **how)

    def causal_chain(self, start: str, target: str, *, sessions=None, **how) -> list[dict] | None:
        return self.graph.causal_chain(start, target, scopes=sessions, **how)

    def trace(self, content: str, direction: str = "causes", *, sessions=None, **how) -> dict:
        return self.graph.trace(content, direction, scopes=sessions, **how)

    def what_if(self, content: str, *, sessions=None, **how) -> dict:
        return self.graph.what_if(content, scopes=sessions, **how)

    def answer(self, query: str, *, sessions=None, **how) -> str:
        return self.graph.answer(query, scopes=sessions, **how)

    def supersede(self, old: str, new: str, session: str | None = None) -> dict:
        """Replaces a fact; False where there is no such fact, which still adds the new one."""
        known = bool(self.graph.lookup([old], "type"))
        entities = self.graph.supersede(old, new, purge_orphans=True)
        if session:
            self.graph.add_nodes([(new, "text")], scopes={session})
        return {"replaced": known, "entities": entities}

    def delete(self, content: str) -> bool:
        return self.graph.delete(content, purge_orphans=True)

    def history(self, content: str) -> dict:
        return self.graph.history(content)

    def forget(self, session: str) -> dict[str, int]:
        return self.graph.forget(session)

    def forget_stale(self, days: int | None = None) -> int:
        return self.graph.delete_stale(days)

    def maybe_forget(self) -> int:
        return self.graph.maybe_forget()

    def list_sessions(self, prefix: str = "") -> list[str]:
        return sorted(r["scope"] for r in store.list_scopes(store.node_scopes(self.graph.nodes), prefix).collect())

    def stats(self) -> dict[str, int]:
        n = self.graph.nodes.agg(F.count_if(F.col("type") == "text").alias("facts"), F.count_if(F.col("type") == "entity").alias("entities")).first()
        return {"facts": n["facts"], "entities": n["entities"], "edges": self.graph.edges.count(), "sessions": len(self.list_sessions()), "pending": self.pending_extractions()}

    def facts(self, session: str | None = None) -> DataFrame:
        """(content, scopes, entities without causal spans, causes) of all facts, or a session's."""
        nodes, edges = self.graph.nodes, self.graph.edges
        own = store.chosen(nodes, "text", [session] if session else None).select("content", "scopes")
        spans = self.graph._roles().select("content").distinct()
        names = nodes.where("type = 'entity'").select("content").join(spans, "content", "left_anti").withColumnRenamed("content", "entity")
        ends = edges.select(F.col("src").alias("entity"), F.col("dst").alias("content")).unionAll(edges.select("dst", "src"))
        named = ends.join(names, "entity", "left_semi").join(own.select("content"), "content", "left_semi").groupBy("content").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
        said = store.relations_by_fact(edges).withColumnRenamed("fact", "content")
        return own.join(named, "content", "left").join(said, "content", "left").select("content", "scopes", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("causes", F.array().cast("array<struct<cause:string,effect:string>>")).alias("causes"))

    def health(self) -> bool:
        return True

    def ready(self) -> bool:
        """Whether the tables can be read."""
        return self.graph.nodes.limit(1).count() >= 0


def from_environment(spark, environment: dict[str, str], *, models: dict[str, Callable] | None = None) -> MemoryService:
    """A service from settings: GRAPH_TABLES (a folder to read), FORGET_AFTER_DAYS, DEDUP_THRESHOLD, SPLIT_SENTENCES, DEFER_EXTRACTION, API_KEYS.

    Without API_KEYS or an explicit ALLOW_ANONYMOUS it refuses to start. models has callables by FactGraph argument.
    """
    if not environment.get("API_KEYS") and environment.get("ALLOW_ANONYMOUS") != "yes":
        raise ValueError("set API_KEYS, or ALLOW_ANONYMOUS=yes")
    graph = FactGraph(spark, forget_after=int(environment.get("FORGET_AFTER_DAYS", "30")), **(models or {}))
    if environment.get("GRAPH_TABLES"):
        from factweave.sources.graph import read_parquet

        graph.load(*read_parquet(spark, environment["GRAPH_TABLES"]))
    yes = lambda k: environment.get(k) == "yes"
    return MemoryService(graph, defer_extraction=yes("DEFER_EXTRACTION"), dedup_threshold=float(environment["DEDUP_THRESHOLD"]) if environment.get("DEDUP_THRESHOLD") else None, split_sentences=yes("SPLIT_SENTENCES"))
