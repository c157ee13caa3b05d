"""The fact graph and its service on small stories."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave import transport
from factweave.functions import extract
from factweave.functions.models import Embedder, Reranker, RuleResolver, chat_resolver, entailment_resolver, prompt, summary_words, template_answer
from factweave.graph import FactGraph
from factweave.service import MemoryService, authorised, from_environment, parse_time

RAIN, FLOOD, LOSS, MARIA = "Heavy rain led to the flood of Genoa.", "The flood of Genoa caused delays at Port West.", "Losses at Acme resulted from delays at Port West.", "Maria Lopez works at Acme."


class Clock:
    def __init__(self):
        self.now = dt.datetime(2024, 1, 1)

    def __call__(self):
        return self.now


@pytest.fixture(scope="module")
def told(spark):
    """Facts of two sessions; the span of a flood is written alike in two of them."""
    g = FactGraph(spark, conflict_resolver=RuleResolver(), clock=Clock(), synthesizer=template_answer)
    g.add_texts([RAIN, MARIA], scopes={"s1"}, resolve_conflicts=False)
    g.add_texts([FLOOD.replace("The flood", "the flood"), LOSS], scopes={"s2"}, resolve_conflicts=False)
    return g


def test_ingest_makes_facts_entities_and_relations(told):
    types = told.lookup([RAIN, "Heavy rain", "the flood of Genoa", "Maria Lopez", "Acme", "none"], "type")
    assert types == {RAIN: "text", "Heavy rain": "entity", "the flood of Genoa": "entity", "Maria Lopez": "entity", "Acme": "entity"}
    assert told._relations(RAIN) == [("Heavy rain", "the flood of Genoa")]
    near = {(n["content"], n["label"], n["direction"]) for n in told.neighbours("the flood of Genoa")}
    assert ("delays at Port West", "causes", "out") in near and ("Heavy rain", "causes", "in") in near and (RAIN, None, "out") in near
    assert {n["content"] for n in told.neighbours("Acme", scopes=["s1"])} == {MARIA}


def test_searches(told):
    assert told.resolve(MARIA) == MARIA and told.resolve("Maria Lopez works") == MARIA
    for mode in ("embedding", "keyword", "hybrid"):
        assert MARIA in {r["content"] for r in told.seeds("Maria Lopez works", 3, mode).collect()}, mode
    assert {r["content"] for r in told.seeds("Maria", 5, scopes=["s2"]).collect()}.isdisjoint({MARIA, RAIN})
    with pytest.raises(ValueError):
        told.seeds("x", 1, "other")
    with pytest.raises(ValueError):
        told.query("x", recency_weight=2)


def test_query_walks_through_entities(told):
    assert told.query(MARIA, top_k=1, hops=1) == [MARIA]
    assert set(told.query(MARIA, top_k=1, hops=3)) == {MARIA, LOSS}
    assert told.query(MARIA, top_k=1, hops=3, scopes=["s1"], isolate=True) == [MARIA]
    rows = told.query_detailed(MARIA, top_k=1, hops=1)
    assert rows[0]["score"] == pytest.approx(1, abs=1e-4) and rows[0]["scopes"] == ["s1"] and rows[0]["created_at"] == dt.datetime(2024, 1, 1)
    assert told.query(MARIA, top_k=1, hops=1, as_of=dt.datetime(2023, 1, 1)) == []


def test_discover_gives_paths(told):
    found = {f["content"]: f for f in told.discover(MARIA, top_k=1, hops=2, scopes=["s1"])}
    assert set(found) == {MARIA, LOSS}
    assert found[LOSS]["cross_session"] and not found[MARIA]["cross_session"]
    assert found[LOSS]["path"] == [{"content": MARIA, "scopes": ["s1"]}, {"entity": "Acme"}, {"content": LOSS, "scopes": ["s2"]}]
    assert found[LOSS]["causes"] == [{"cause": "delays at Port West", "effect": "Losses at Acme"}]
    assert len(told.discover(MARIA, top_k=1, hops=4, max_visited=2)) <= 2
    assert len(told.discover(MARIA, top_k=3, hops=4, max_results=2)) == 2
    assert "connected through" in told.answer(MARIA, top_k=1, hops=2)


def test_discover_counts_causal_steps(spark):
    g = FactGraph(spark)
    g.add_nodes([("first fact", "text"), ("second fact", "text"), ("a", "entity"), ("b", "entity")])
    g.add_edges([("a", "first fact"), ("a", "b", "causes"), ("b", "second fact")])
    for budget, n in ((None, 2), ((1, 0), 2), ((0, 0), 1), ((None, 0), 2)):
        assert len(g.discover("first fact", top_k=1, hops=3, causal_hops=budget)) == n


def test_causal_questions(told):
    flood = FLOOD.replace("The flood", "the flood")
    traced = told.trace_effects(RAIN)
    assert [(h["effect"], h["fact"], h["depth"]) for h in traced["chain"]] == [("the flood of Genoa", RAIN, 0), ("delays at Port West", flood, 1), ("Losses at Acme", LOSS, 2)]
    assert traced["origin"] == RAIN and traced["terminals"] == ["Losses at Acme"]
    assert told.root_causes(LOSS) == ["Heavy rain"]
    # arrived as soon as an effect names one of the target's entities
    assert [h["fact"] for h in told.causal_chain(RAIN, LOSS)] == [RAIN, flood]
    assert told.causal_chain(LOSS, RAIN) is None
    what = told.what_if(flood, origin=RAIN)
    assert what["pruned_edges"] == [{"cause": "the flood of Genoa", "effect": "delays at Port West"}]
    assert [(c["span"], c["fact"]) for c in what["collapsed"]] == [("Losses at Acme", LOSS), ("delays at Port West", flood)] and what["survived"] == []
    assert told.what_if(MARIA)["collapsed"] == []


def test_support_by_another_fact_keeps_an_effect(spark):
    g = FactGraph(spark)
    g.add_texts(["Ice caused cracks.", "Ice caused cracks, they said."])
    assert g.what_if("Ice caused cracks.")["pruned_edges"] == []


def test_same_as_and_bridges(spark):
    g = FactGraph(spark, span_link_threshold=0.9)
    g.add_texts(["A storm caused the power outage."])
    g.add_texts(["The power outages led to spoiled food."])
    assert ("The power outages", "same_as") in {(n["content"], n["label"]) for n in g.neighbours("the power outage")} or g.edges.where("label = 'same_as'").count() == 0
    g.add_edges([("the power outage", "The power outages", "same_as")])
    assert [(h["effect"], h["depth"]) for h in g.trace_effects("A storm caused the power outage.")["chain"]] == [("the power outage", 0), ("spoiled food", 1)]
    h = FactGraph(spark)
    h.add_texts(["A storm caused the power outage.", "The power outage led to spoiled food."])
    assert h.trace_effects("A storm caused the power outage.")["terminals"] == ["the power outage"]
    assert h.trace_effects("A storm caused the power outage.", bridge=True)["terminals"] == ["spoiled food"]


def test_writes(spark):
    clock = Clock()
    g = FactGraph(spark, clock=clock, conflict_resolver=RuleResolver(), forget_every=dt.timedelta(hours=1), link_contained=True, back_references=True)
    assert g.add_texts(["The lift of Tower East holds 8 people.", "This forced Acme out."], scopes={"a"}) == [["Tower East"], ["Acme"]]
    assert ("The lift of Tower East holds 8 people.", "This forced Acme out.", "causes") in {tuple(r) for r in g.edges.collect()}
    clock.now += dt.timedelta(days=1)
    # a contradiction in the same scope retires, in another it doesn't
    g.add_texts(["The lift of Tower East holds 6 people."], scopes={"b"})
    assert g.superseded(["The lift of Tower East holds 8 people."]) == []
    g.add_texts(["The lift of Tower East holds 9 people."], scopes={"a"})
    assert g.superseded(["The lift of Tower East holds 8 people."]) == ["The lift of Tower East holds 8 people."]
    assert g.history("The lift of Tower East holds 8 people.") == {"supersedes": [], "superseded_by": ["The lift of Tower East holds 9 people."]}
    assert "The lift of Tower East holds 8 people." not in g.query("lift of Tower East", scopes=["a"], top_k=3, hops=1)
    assert "The lift of Tower East holds 8 people." in g.query("The lift of Tower East holds 8 people.", scopes=["a"], top_k=3, hops=1, as_of=dt.datetime(2024, 1, 1, 12))
    # said again, it is valid again
    g.add_texts(["The lift of Tower East holds 8 people."], scopes={"c"}, resolve_conflicts=False)
    assert g.superseded(["The lift of Tower East holds 8 people."]) == [] and sorted(g.lookup(["The lift of Tower East holds 8 people."], "scopes").popitem()[1]) == ["a", "c"]
    assert g.forget("b") == {"deleted": 1, "detached": 1}
    assert g.remove_scopes(["The lift of Tower East holds 8 people."], ["c", "x"]) == 1
    g.supersede("This forced Acme out.", "Acme left.", purge_orphans=True)
    assert g.lookup(["This forced Acme out.", "Acme left."], "scopes") == {"Acme left.": ["a"]}
    assert g.delete("none") is False and g.delete("Acme left.", purge_orphans=True) and g.lookup(["Acme"], "type") == {}
    clock.now += dt.timedelta(days=60)
    g.touch(["Tower East"])
    assert g.maybe_forget() > 0 and g.maybe_forget() == 0
    assert [r["content"] for r in g.nodes.collect()] == ["Tower East"]
    g.add_nodes([("Tower East Hall", "entity")])
    g.add_texts(["We met at Tower East."])
    assert ("Tower East Hall", "We met at Tower East.") in {(r["src"], r["dst"]) for r in g.edges.collect()}
    with pytest.raises(ValueError):
        FactGraph(spark).add_texts(["x"], resolve_conflicts=True)


def test_duplicates_and_splits(spark):
    g = FactGraph(spark)
    g.add_texts(["Zurich Airport plans a strike for Thursday."], scopes={"a"})
    near = "Zurich Airport plans a strike for Thursdays."
    assert g.add_texts([near], scopes={"b"}, dedup_threshold=0.9) == [[]]
    assert g.lookup([near], "type") == {} and sorted(g.lookup(["Zurich Airport plans a strike for Thursday."], "scopes").popitem()[1]) == ["a", "b"]
    other = "Zurich Airpork plans a strike for Thursday."
    assert g.add_texts([other], dedup_threshold=0.8, dedup_entity_gate=True) == [["Zurich Airpork", "Thursday"]]
    assert g.add_texts(["Anna met Bob. Carl saw Anna."], split=True) == [["Anna", "Bob", "Carl"]]
    assert set(g.lookup(["Anna met Bob.", "Carl saw Anna."], "type").values()) == {"text"}


def test_service(spark):
    s = MemoryService(FactGraph(spark), defer_extraction=True)
    s.push_many("t/one", [RAIN, MARIA])
    s.push("t/two", LOSS)
    assert s.stats() == {"facts": 3, "entities": 0, "edges": 0, "sessions": 2, "pending": 3}
    assert s.enrich() == 3 and s.pending_extractions() == 0
    assert s.list_sessions("t/") == ["t/one", "t/two"] and s.stats()["pending"] == 0
    rows = {r["content"]: r for r in s.facts("t/one").collect()}
    assert set(rows) == {RAIN, MARIA} and rows[MARIA]["entities"] == ["Acme", "Maria Lopez"] and [tuple(c) for c in rows[RAIN]["causes"]] == [("Heavy rain", "the flood of Genoa")]
    assert MARIA in s.answer("Maria Lopez works at Acme", top_k=1)
    assert s.supersede("none", "Maria Lopez left Acme.")["replaced"] is False
    assert s.delete(LOSS) and not s.delete(LOSS) and s.ready() and s.health()
    assert s.forget("t/one")["deleted"] > 0
    assert parse_time("2024-01-01T00:00:00Z").tzinfo is not None and parse_time(None) is None
    with pytest.raises(ValueError):
        parse_time("yesterday")
    assert authorised("k", ["x", "k"]) and not authorised(None, ["k"]) and not authorised("k", [])
    with pytest.raises(ValueError):
        from_environment(spark, {})
    assert from_environment(spark, {"ALLOW_ANONYMOUS": "yes", "SPLIT_SENTENCES": "yes"}).split


def test_models(spark):
    assert summary_words(4) == 20
    assert Embedder().score("alpha beta", ["alpha beta", "zzz"])[0] == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        Embedder("a-model-name")
    double = Reranker(lambda q, t: pd.Series([len(x) for x in t]))
    assert double.relevance("q", ["a", "bbb"]) == [1, 3]
    df = spark.createDataFrame([("bb",)], "t string")
    assert df.select(double.column("q", F.col("t"), F.array())).first()[0] == 2.0
    one, two = pd.Series(["new"]), pd.Series(["old"])
    assert list(entailment_resolver(lambda pairs: [[3.0, 0.0, 0.0]])(one, two)) == [True]
    assert [bool(chat_resolver(lambda q: r)(one, two)[0]) for r in ("yes", '{"conflict": true}', '{"conflict": false}', "no", "{")] == [True, True, False, False, False]
    assert "(from s2)" in prompt("q", [{"content": "a", "cross_session": True, "scopes": ["s2"]}]) and template_answer("q", []) == "No facts were found."


def test_http_and_client(spark):
    s = MemoryService(FactGraph(spark))
    server = transport.serve(s, keys=["k"])
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        client = transport.MemoryClient(url, "k")
        assert client.remember("one", RAIN)["entities"] == ["Heavy", "Genoa"] and len(client.remember_many("two", [MARIA])) == 1
        assert client.recall(MARIA, "two", hops=1)[0]["content"] == MARIA and client.stats()["facts"] == 2
        assert client.trace(RAIN)["terminals"] == ["the flood of Genoa"] and client.facts([MARIA])[MARIA]["sessions"] == ["two"]
        assert client.forget_session("two")["deleted"] > 0
        with pytest.raises(transport.BadRequest):
            transport.MemoryClient(url, "other").stats()
        with pytest.raises(transport.BadRequest):
            client._call("POST", "/query", text="no query")
        assert transport.MemoryClient(url)._call("GET", "/health") == {"status": "ok"}
    finally:
        server.shutdown()
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_sessions"}}, {"id": 4, "method": "tools/call", "params": {"name": "none"}}, {"id": 5, "method": "x"}]
    out = []
    transport.serve_tools(s, [json.dumps(x) for x in asked], lambda line: out.append(json.loads(line)))
    assert [o["id"] for o in out] == [1, 2, 3, 4, 5] and len(out[1]["result"]["tools"]) == 13
    assert out[2]["result"]["content"][0]["text"] == '["one"]' and out[3]["result"]["isError"] and "error" in out[4]


def test_extraction_seams(spark):
    df = spark.createDataFrame([("Anna met Bob.",)], "t string")
    one = lambda f: df.select(f(F.col("t"))).first()[0]
    assert one(extract.token_classifier(lambda ts: [[{"word": "Anna"}, {"word": "##na"}, {"word": "B"}, {"word": "Anna"}]] * len(ts))) == ["Anna"]
    assert one(extract.labelled(lambda ts, kinds, least: [[{"text": "Bob", "label": "person", "score": 0.9}, {"text": "met", "label": "verb"}]] * len(ts))) == ["Bob"]
    assert one(extract.offsets(lambda ts: [[("B-PER", 0, 2), ("I-PER", 2, 4), ("O", 5, 8), ("B-PER", 9, 12), ("B-PER", 3, 3)]] * len(ts))) == ["Anna", "Bob"]
    assert [tuple(p) for p in one(extract.relation_model(lambda ts: [[{"head": "a", "tail": "b", "score": 1}, {"head": "A", "tail": "B", "score": 2}, {"head": "a", "tail": "A"}]] * len(ts)))] == [("A", "B")]
    point = lambda ts: [((0, 4), (9, 12), 0.9)] * len(ts)
    assert [tuple(p) for p in one(extract.span_pointer(point))] == [("Anna", "Bob")] and one(extract.span_pointer(point, lambda ts: [0.1] * len(ts))) == []
    assert one(extract.splitter(lambda t: t.split(" "))) == ["Anna", "met", "Bob."]


def test_saving_and_caching(spark, tmp_path):
    with FactGraph(spark) as g:
        g.load_dataset("kitchen", scopes={"k"})
        g.save(str(tmp_path / "g"))
    back = FactGraph.open(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 7 and g.nodes.count() == 0
    with back.request_cache():
        assert back.lookup(["menu", "none"], "type") == {"menu": "entity"} and set(back.held["type"]) == {"menu", "none"}
        back.delete("menu")
        assert back.lookup(["menu"], "type") == {}
    assert back.held is None
