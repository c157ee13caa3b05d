"""Operators on small graphs written out here."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.functions import text, vector
from factweave.operators import ingest as plans
from factweave.operators import search, store, walk
from factweave.sources import graph
from factweave.streaming import ingest


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_walk_stops_at_cycles_and_prefers_least_parent(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    got = walk.reach(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert pairs(got) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")]


def test_what_if_keeps_what_another_branch_holds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "x"), ("c", "x"), ("b", "y")], "src string, dst string")
    support = spark.createDataFrame([("a", "b", "f1"), ("a", "c", "f2"), ("b", "x", "f3"), ("c", "x", "f4"), ("b", "y", "f5")], "src string, dst string, fact string")
    got = walk.collapsed(edges, support, spark.createDataFrame([("f1",)], "fact string"), spark.createDataFrame([("a",)], "node string"), 4)
    assert pairs(got) == [("b", 1), ("y", 2)]


def test_redundant_support_cuts_nothing(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    support = spark.createDataFrame([("a", "b", "f1"), ("a", "b", "f2")], "src string, dst string, fact string")
    assert walk.collapsed(edges, support, spark.createDataFrame([("f1",)], "fact string"), spark.createDataFrame([("a",)], "node string"), 2).count() == 0


def test_self_loop_is_one_neighbour(spark):
    edges = spark.createDataFrame([("a", "a", None), ("a", "b", None), ("b", "a", "causes")], "src string, dst string, label string")
    assert pairs(walk.neighbours(edges)) == [("a", "a", None, "out"), ("a", "b", "causes", "in"), ("b", "a", "causes", "out")]


def test_zero_vectors_have_similarity_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_merge_keeps_an_old_label(spark):
    edges = spark.createDataFrame([("a", "b", "causes", 1), ("a", "b", None, 2)], "src string, dst string, label string, seq long")
    assert pairs(store.merge_edges(edges)) == [("a", "b", "causes")]


def test_blend_of_flat_scores(spark):
    hits = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, None)], "content string, score double, ts double")
    assert pairs(search.blend(hits, 0.5)) == [("a", 0.5), ("b", 0.25)]


def test_canonical_is_never_empty(spark):
    df = spark.createDataFrame([("Acme  Corp, Inc.",), ("Inc",)], "n string")
    assert [r[0] for r in df.select(text.canonical(F.col("n"))).collect()] == ["Acme", "Inc"]


def test_graph_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"content": "a", "type": "text", "scopes": ["s"]}], "edges": [{"from_content": "a", "to_content": "b", "label": null}]}')
    nodes, edges = graph.read_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 1 and pairs(edges) == [("a", "b", None)]
    nodes, edges = graph.read_json(spark, str(tmp_path / "none.json"))
    assert nodes.count() == 0 and edges.count() == 0


def test_graph_documents_are_written_and_read(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "text", [1.0], None, None, ["t", "s"], None), ("a", "entity", [0.5], None, None, [], None)], graph.NODES)
    edges = spark.createDataFrame([("a", "b", "causes")], "src string, dst string, label string")
    graph.write_json(nodes, edges, str(tmp_path / "g"))
    back, lines = graph.read_json(spark, str(tmp_path / "g"))
    assert sorted((r["content"], r["type"], list(r["scopes"])) for r in back.collect()) == [("a", "entity", []), ("b", "text", ["s", "t"])] and pairs(lines) == [("a", "b", "causes")]
    graph.write_parquet(nodes, edges, str(tmp_path / "p"))
    inside, _ = graph.read_parquet(spark, str(tmp_path / "p"), ["s"])
    assert [r["content"] for r in inside.collect()] == ["b"]


def test_data_sets(spark):
    assert len(graph.datasets()) == 6
    for name in graph.datasets():
        nodes, edges = graph.load_dataset(spark, name)
        known = {r["content"] for r in nodes.collect()}
        assert all(r["src"] in known and r["dst"] in known for r in edges.collect())
    with pytest.raises(ValueError):
        graph.load_dataset(spark, "none")


def test_causal_cues():
    cases = {
        "The dam failed because rain fell.": ("rain fell", "The dam failed"),
        "Heat leads to drought.": ("Heat", "drought"),
        "Because of rain, the match stopped": None,  # nothing stands before it in its clause
        "On Monday, the pump broke due to ice; nobody saw it": ("ice", "the pump broke"),
        "They studied the causes of decay": None,
        "Smoking causes cancer, doctors say": ("Smoking", "cancer"),
        "which led to losses": None,
        "Der Zug hielt wegen eines Signals": ("eines Signals", "Der Zug hielt"),
        "停电导致停工": ("停电", "停工"),
        "Sales fell as a result of the strike": ("the strike", "Sales fell"),
        "Nothing here.": None,
        None: None,
    }
    for sentence, want in cases.items():
        assert text.cue_relation(sentence) == want, sentence


def test_names_and_back_references(spark):
    df = spark.createDataFrame([("Foo Group Holdings",), ("The  Fed",), ("AAPL",), ("  ",)], "n string")
    aliases = {"the fed": "Federal Reserve", "aapl": "Apple Inc."}
    assert [r[0] for r in df.select(text.canonical(F.col("n"), aliases)).collect()] == ["Foo", "Federal Reserve", "Apple", ""]
    df = spark.createDataFrame([("“Bulk Export’s”",), ("Apple Inc.",), ("Işık",), ("ＡＢＣ",)], "n string")
    assert [r[0] for r in df.select(text.normal(F.col("n"))).collect()] == ["bulk export", "apple", "ışık", "abc"]
    df = spark.createDataFrame([("This broke the invoice run.",), ("This is fine.",), ("Dadurch fiel er aus.",), ("So, they left",), ("Sofas are sold",), ("Bu nedenle durdu",)], "t string")
    assert [r[0] for r in df.select(text.back_referenced_cause(F.col("t"))).collect()] == [True, False, True, True, False, True]
    df = spark.createDataFrame([("Dr. Who came. He left, e.g. by bus. Then\nA new line",)], "t string")
    assert df.select(text.sentences(F.col("t"))).first()[0] == ["Dr. Who came.", "He left, e.g. by bus.", "Then", "A new line"]
    df = spark.createDataFrame([('{"conflict": true}',), ("yes",)], "t string")
    assert [r[0] for r in df.select(text.conflict_reply(F.col("t"))).collect()] == [True, None]


def test_approximate_neighbours_are_nearly_exact(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    rows = [(f"n{i}", (centre[i % 12] * (1 if i % 3 else 2) + rng.normal(size=16) * 0.7).tolist()) for i in range(1500)]
    nodes = spark.createDataFrame(rows, "content string, embedding array<float>")
    asked = nodes.where("substr(content, -2) = '00'").withColumnRenamed("content", "query")
    exact = {(r["query"], r["content"]) for r in search.knn_join(asked, nodes, 10).collect()}
    found = {(r["query"], r["content"]) for r in search.knn_join_approximate(asked, nodes, 10, cells=24, probe=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ranks_are_global(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("content"), (F.col("id") * 37 % 101).alias("score")).repartition(5)
    got = [(r["r"], r["content"]) for r in search.ranked(df, "r", F.desc("score"), F.col("content")).orderBy("r").collect()]
    want = sorted(((-(i * 37 % 101), str(i)) for i in range(1000)))
    assert got == [(i + 1, c) for i, (_, c) in enumerate(want)]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    kind = "k string, at timestamp, v int"
    src = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame([(k, dt.datetime(2024, 1, d), v) for k, d, v in rows], kind).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(kind).parquet(src)
    put(("a", 1, 1), ("b", 2, 2))
    first = ingest.upsert(read(), "k", "at", str(tmp_path / "state"))
    assert sorted((r["k"], r["v"]) for r in first.collect()) == [("a", 1), ("b", 2)]
    put(("a", 3, 3), ("b", 1, 9))
    again = ingest.upsert(read(), "k", "at", str(tmp_path / "state"))
    assert sorted((r["k"], r["v"]) for r in again.collect()) == [("a", 3), ("b", 2)]
    over = ingest.retired(read(), "k", "at", str(tmp_path / "versions"))
    assert sorted((r["k"], r["v"]) for r in over.collect()) == [("a", 1), ("b", 9)]
    none = spark.readStream.schema(kind).parquet(str(tmp_path / "in"), pathGlobFilter="*.nothing")
    assert ingest.upsert(none, "k", "at", str(tmp_path / "empty")).count() == 0


def test_streams_enrich_facts(spark, tmp_path):
    kind = "seq long, text string, scopes array<string>"
    spark.createDataFrame([(1, "Rain led to floods in Genoa.", ["s"])], kind).write.parquet(str(tmp_path / "in"))
    nodes, edges = ingest.enriched(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), plans.plan)
    assert {"Rain", "floods in Genoa", "Genoa"} <= {r["content"] for r in nodes.collect()}
    assert ("Rain", "floods in Genoa", "causes") in {(r["src"], r["dst"], r["label"]) for r in edges.collect()}
    assert ingest.pending(spark, str(tmp_path / "out")) == 0


def test_cues_that_a_text_does_not_have_are_not_searched(monkeypatch):
    said, low = "The fan stopped because of dust.", "the fan stopped because of dust."

    class Absent:
        def finditer(self, _):
            raise AssertionError("searched")

    monkeypatch.setattr(text, "_CUES", [(rx if cue in low else Absent(), cue, before) for rx, cue, before in text._CUES])
    assert text.cue_relation(said) == ("dust", "The fan stopped")


def test_blocks_of_queries_are_compared_some_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"n{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(50)]
    nodes = spark.createDataFrame(rows, "content string, embedding array<float>").coalesce(1)
    found = [sorted(map(tuple, search.knn_join(nodes.withColumnRenamed("content", "query"), nodes, 3).collect()))]
    monkeypatch.setattr(search, "ROWS", 7)
    found.append(sorted(map(tuple, search.knn_join(nodes.withColumnRenamed("content", "query"), nodes, 3).collect())))
    assert found[0] == found[1] and len(found[0]) == 150


def test_single_walks_shuffle_no_edges(spark):
    """Edges that repeat meet a small frontier, and facts only those of its nodes: all edges are never dealt out by key."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    facts_ = spark.createDataFrame([("a", "b", "f"), ("a", "b", "f"), ("a", "c", "f"), ("a", "c", "g"), ("d", "e", "f")], "src string, dst string, fact string")
    gone = spark.createDataFrame([("f",)], "fact string")
    assert pairs(walk.solely_supported(facts_, gone)) == [("a", "b"), ("d", "e")]
    assert "REPARTITION_BY_NUM" in walk.solely_supported(facts_, gone)._jdf.queryExecution().executedPlan().toString()
    asked = []

    def blocked(nodes):
        asked.append(sorted(r["src"] for r in nodes.collect()))
        return walk.solely_supported(facts_, gone, nodes)

    assert pairs(walk.reach(edges, starts, 3, blocked=blocked).select("node", "depth")) == [("a", 0), ("c", 1), ("d", 2)]
    assert asked == [["a"], ["c"], ["d"]]
    assert pairs(walk.collapsed(edges, facts_, gone, starts, 3)) == [("b", 1), ("e", 3)]
    assert pairs(walk.terminals(edges, walk.reach(edges, starts, 3))) == [("e", 3)]
    plan = walk.terminals(edges, walk.reach(edges, starts, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert pairs(walk.budgeted(edges, starts, 1, 1)) == [("a", 0, 0), ("b", 1, 0), ("c", 1, 0)]
    scores = edges.select("src", F.ascii("src").cast("double").alias("score")).unionAll(edges.select("dst", F.ascii("dst").cast("double"))).toDF("node", "score")
    assert pairs(walk.reranked(edges, scores, starts, 3, 1)) == [("a", 0), ("c", 1), ("d", 2)]


def brute_fuzzy(rows, query, least=0.45):
    """(content, score) of rows (content, text), by plain loops."""
    grams = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    hits = set()
    for content, text_ in rows:
        for word in re.findall(r"\w{2,}", (text_ or "").lower()):
            a = grams(word)
            hits |= {(content, q) for q in query if len(a & grams(q)) / len(a | grams(q)) >= least}
    df = Counter(q for _, q in hits)
    scores = Counter()
    for content, q in hits:
        scores[content] += math.log(1 + len(rows) / df[q])
    return {c: round(x, 6) for c, x in scores.items()}


def many_words(spark, n=1500):
    rng = random.Random(5)
    near = ["trash", "trsh", "trashes", "Licence", "licenses", "öffnen", "offnen", "a"]
    rows = [(f"d{i % (n - 9)}", " ".join([f"w{rng.randrange(400)}" for _ in range(20)] + rng.sample(near, 1 if i % 3 else 0))) for i in range(n)]
    rows += [("none", None), ("empty", ""), ("signs", "- . -")]
    return rows, spark.createDataFrame(rows, "content string, text string").repartition(4).localCheckpoint()


def shuffled(spark, run):
    """Rows that all stages of run() write to shuffles."""
    status = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = status.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def test_similar_text_looks_at_texts_once(spark):
    """Query words that texts have are shuffled, not the texts' words; nothing is searched a second time."""
    rows, docs = many_words(spark)
    got, n = shuffled(spark, lambda: search.similar_text(docs, "trash licence", 2000).collect())
    assert dict(map(tuple, got)) == brute_fuzzy(rows, ["trash", "licence"])
    assert n < 6000 < 20 * len(rows)


def test_similar_text_falls_back_to_whole_texts(spark):
    docs = spark.createDataFrame([("a", "abcdefgh"), ("b", "zzz"), ("c", None)], "content string, text string")
    assert [r["content"] for r in search.similar_text(docs, "abcd", 5).collect()] == ["a"]


@pytest.mark.parametrize("query", [["trash"], ["licence", "öffnen", "w17"], ["trash"] * 2, ["nowhere"], ["of the", "w(1", "a"], [f"w{i}" for i in range(60)]])
def test_fuzzy_words_are_matched_where_they_are_read(spark, query):
    """Query words that texts have are shuffled, not the texts' words."""
    rows, docs = many_words(spark)
    got, n = shuffled(spark, lambda: search.fuzzy_keyword(docs, query, None).collect())
    assert {r["content"]: r["score"] for r in got} == pytest.approx(brute_fuzzy(rows, set(query)), abs=2e-6)
    assert n < (40 if len(query) > 9 else 4) * len(rows)
