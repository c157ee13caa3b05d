"""Queries over stored structures: the vector index, the inverted index, adjacency."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.operators import search, walk
from factweave.operators.adjacency import Adjacency
from factweave.operators.word_index import WordIndex
from factweave.plans.graph_queries import ORACLE, QUERIES
from factweave.plans.queries import FUZZY, KEY, SUP, WORDS, first_vector, g_doc, g_sup, g_vec, named_docs, query
from factweave.session import checkpoint, shared_folder, stored
from factweave.session import table as t
from factweave.sources import versions
from factweave.sources.versions import VersionedTable

__all__ = ["ORACLE", "QUERIES"]


# vectors

@query("SELECT 'v'||vec_id AS query, true AS recalled, true AS right FROM embeddings WHERE vec_id%50=0")
def knn_index_recalled(s, d):
    """Whether the index finds nine or more of each query's ten nearest nodes, and gives the scores of those it finds."""
    v = g_vec(s, d)
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("content", "query")
    exact = search.knn_join(asked, v, 10).select("query", "content", F.col("score").alias("exact"))
    found = exact.join(search.knn_join_approximate(asked, v, 10).select("query", "content", "score"), ["query", "content"], "left")
    right = F.min(F.col("score").isNull() | (F.abs(F.col("score") - F.col("exact")) < 1.5e-6))
    return found.groupBy("query").agg((F.count("score") >= F.least(F.lit(9), F.count("exact"))).alias("recalled"), right.alias("right"))


# words

def word_index(s, d) -> WordIndex:
    """The index of all documents, made by the first query that needs it."""
    return WordIndex(s, stored(s, "words", [f"{d}/documents.parquet"], lambda folder: WordIndex.build(named_docs(s, d), folder)))


@query(ORACLE["keyword_idf_top"])
def keyword_index_top(s, d):
    return word_index(s, d).keyword(WORDS, 25)


@query(f"WITH {KEY} SELECT * FROM kw")
def keyword_index_all(s, d):
    return word_index(s, d).keyword(WORDS, None)


@query(ORACLE["keyword_fuzzy_top"])
def keyword_index_fuzzy(s, d):
    return word_index(s, d).fuzzy(FUZZY, 25)


@query(ORACLE["hybrid_rrf_window"])
def hybrid_index_window(s, d):
    """Both channels as far as their window; the index ends its own early."""
    near = search.scored(g_vec(s, d), first_vector(s, d)).withColumn("content", F.regexp_replace("content", "v", "d"))
    return search.fuse(near, word_index(s, d).keyword(WORDS, 100), window=100)


@query(rf"""WITH w AS (SELECT 'd'||doc_id AS content, unnest(list_distinct(regexp_extract_all(lower(text),'[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'))) AS word FROM documents),
f AS (SELECT word, ln(1+(SELECT count(*) FROM documents)/count(*)) AS weight FROM w WHERE word IN ('of','the') GROUP BY word),
kw AS (SELECT content, round(sum(weight),6) AS score FROM w JOIN f USING (word) GROUP BY content)
SELECT content, score, row_number() OVER (ORDER BY score DESC, content)::INT AS rank FROM
(SELECT 'd'||doc_id AS content, coalesce(score, 0) AS score FROM documents LEFT JOIN kw ON kw.content='d'||doc_id WHERE contains(lower(text), 'of the') ORDER BY score DESC, content LIMIT 25)""")
def keyword_phrase_ranked(s, d):
    """The best 25 of the contents with a phrase, in order."""
    found = word_index(s, d).phrase(named_docs(s, d), "of the", 25)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "content")))


# adjacency and walks of many questions

TIES = "q AS (SELECT 'p'||p_partkey AS a, 'p'||(p_partkey+1) AS b FROM part WHERE p_partkey%10=0), t AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q)"
ASKED = "z AS (SELECT 'p'||p_partkey AS question FROM part WHERE p_partkey%50=0)"
OUT = "direction = 'out' and label is null"


def supply(s, d) -> Adjacency:
    """Suppliers, parts, orders, customers and nations, and ties between parts, made by the first query that needs it."""

    def make(folder):
        ties = t(s, d, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("dst"), F.lit("same_as").alias("label"))
        Adjacency.build(g_sup(s, d, repeats=True).withColumn("label", F.lit(None).cast("string")).unionByName(ties), folder)

    return Adjacency(s, stored(s, "supply", [f"{d}/{x}.parquet" for x in ("lineitem", "orders", "customer", "part")], make))


def asked(s, d):
    """Every part whose key is divisible by 50 asks from itself."""
    name = F.concat(F.lit("p"), "p_partkey")
    return t(s, d, "part").where("p_partkey % 50 = 0").select(name.alias("question"), name.alias("node"))


@query(f"""WITH {SUP}, {TIES}, {ASKED}, m AS (SELECT src, dst AS nbr, NULL AS label, 'out' AS direction FROM e UNION ALL SELECT dst, src, NULL, 'in' FROM e
UNION ALL SELECT a, b, 'same_as', 'out' FROM q UNION ALL SELECT b, a, 'same_as', 'in' FROM q)
SELECT question, nbr, label, direction FROM z JOIN m ON m.src=question""")
def stored_neighbours(s, d):
    return supply(s, d).step(asked(s, d)).select("question", "nbr", "label", "direction")


@query(f"""WITH RECURSIVE {SUP}, {ASKED}, m AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT question, question AS node, 0 AS depth FROM z UNION SELECT r.question, m.dst, r.depth+1 FROM r JOIN m ON m.src=r.node WHERE r.depth<2)
SELECT question, node, min(depth)::INT AS depth FROM r GROUP BY ALL""")
def discover_many(s, d):
    """Both directions, two levels, all questions in one walk."""
    return supply(s, d).reach(asked(s, d), 2, "label is null", parents=False).select("question", "node", "depth")


CAUSAL = f"""{SUP}, {TIES}, {ASKED}, st AS (SELECT src, dst, 1 AS cost FROM e UNION ALL SELECT a, b, 0 FROM t),
r AS (SELECT question, question AS node, 0 AS depth FROM z UNION SELECT r.question, st.dst, r.depth+st.cost FROM r JOIN st ON st.src=r.node WHERE r.depth+st.cost<=3),
l AS (SELECT question, node, min(depth) AS depth FROM r GROUP BY ALL), h AS (SELECT question, e.src AS cause, e.dst AS effect, l.depth+1 AS depth FROM l JOIN e ON e.src=l.node WHERE l.depth<3)"""


@query(f"WITH RECURSIVE {CAUSAL} SELECT question, cause, effect, depth::INT AS depth FROM h")
def trace_many(s, d):
    """The effects of all questions' parts, three levels, with parts of one name passed at no cost."""
    g = supply(s, d)
    return g.hops(g.reach(asked(s, d), 2, OUT, ties=True, parents=False), 3, OUT)  # the third level's nodes only end hops


@query(f"""WITH RECURSIVE {CAUSAL} SELECT DISTINCT question, effect AS node FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.question=h.question AND x.cause=h.effect)
AND NOT EXISTS (SELECT 1 FROM t JOIN h x ON x.cause=t.b WHERE t.a=h.effect AND x.question=h.question)""")
def terminals_many(s, d):
    """The effects of trace_many that lead no further, neither themselves nor by parts of one name."""
    g = supply(s, d)
    reached = checkpoint(g.reach(asked(s, d), 2, OUT, ties=True, parents=False))  # all causes of three levels of hops and their ties
    return g.terminals(reached, g.hops(reached, 3, OUT))


@query(f"""WITH RECURSIVE {SUP}, f AS (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst, l_returnflag AS fact FROM lineitem),
z AS (SELECT 's'||s_suppkey||':'||fact AS question, 's'||s_suppkey AS node, fact FROM supplier, (SELECT DISTINCT fact FROM f) WHERE s_suppkey%50=0),
cut AS (SELECT question, src, dst FROM z JOIN f ON f.src=z.node GROUP BY question, src, dst, z.fact HAVING bool_and(f.fact=z.fact)),
r AS (SELECT question, node, 0 AS depth FROM z UNION SELECT r.question, e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<2),
k AS (SELECT question, node, 0 AS depth FROM z UNION SELECT k.question, e.dst, k.depth+1 FROM k JOIN e ON e.src=k.node WHERE k.depth<2 AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.question=k.question AND cut.src=e.src AND cut.dst=e.dst))
SELECT question, node, min(depth)::INT AS depth FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.question=r.question AND k.node=r.node) GROUP BY ALL""")
def what_if_many(s, d):
    """For each supplier divisible by 50 and each return flag: what it reaches only by supplies that this flag alone asserts."""
    line = t(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.concat(F.lit("p"), "l_partkey").alias("nbr"), F.col("l_returnflag").alias("fact"))
    own = checkpoint(t(s, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    asked_ = own.join(line.select("fact").distinct()).withColumn("question", F.concat_ws(":", "node", "fact"))  # three flags
    # no other supplier's supplies are blocked
    sole = line.join(walk.small(own, own.count()), "node", "left_semi").groupBy("node", "nbr").agg(F.min("fact").alias("fact"), F.max("fact").alias("most")).where("fact = most")
    blocked = asked_.join(sole, ["node", "fact"]).select("question", "node", "nbr")
    return supply(s, d).collapsed(asked_.select("question", "node"), 2, blocked, OUT)


# versioned tables

def versioned(s, name, keys, columns, merges) -> VersionedTable:
    return VersionedTable(s, f"{shared_folder(s)}/versioned-{name}-{uuid.uuid4()}", keys, columns, merges)


@query(ORACLE["upsert_union_scopes"])
def versioned_scopes(s, d):
    """Two commits that share contents, then a compaction: scopes united, the least id kept."""
    rows = g_doc(s, d).select(F.col("text").alias("content"), "doc_id", F.array("source").alias("scopes"))
    table = versioned(s, "scopes", "content string", "doc_id long, scopes array<string>", {"doc_id": versions.least, "scopes": versions.union})
    for part in (rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")):
        table.commit(part)
    table.compact()
    return table.read().select("content", "doc_id", F.concat_ws(",", "scopes").alias("scopes"))


@query(ORACLE["edge_label_merge"])
def versioned_labels(s, d):
    """Edges committed in three parts; the last label that isn't null stays."""
    label = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("l"), F.col("event_id") % 7))
    e = t(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), label.alias("label"), F.col("event_id").alias("seq"))
    table = versioned(s, "labels", "src string, dst string", "label string", {"label": versions.latest_known})
    third = e.agg(F.max("seq")).first()[0] // 3 + 1
    for i in range(3):
        table.commit(e.where(F.floor(F.col("seq") / third) == i))
    return table.read()


@query(ORACLE["delete_nodes_left"])
def versioned_deletes(s, d):
    """Parts and suppliers, then large parts and all suppliers deleted, and the suppliers inserted again."""
    name = lambda letter, c: F.concat(F.lit(letter), c).alias("content")
    parts, suppliers = t(s, d, "part"), t(s, d, "supplier").select(name("s", "s_suppkey"), F.lit("supplier").alias("kind"))
    table = versioned(s, "nodes", "content string", "kind string", {})
    table.commit(parts.select(name("p", "p_partkey"), F.lit("part").alias("kind")).unionByName(suppliers.withColumn("kind", F.lit("old"))))
    gone = parts.where("p_size > 25").select(name("p", "p_partkey")).unionByName(suppliers.select("content"))
    table.update(lambda held: (suppliers, held.join(gone, "content", "left_semi")))
    return table.read()


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id <= (SELECT max(event_id)//2 FROM events) GROUP BY user_id")
def versioned_snapshot(s, d):
    """What a table was before its second commit and its compaction."""
    events = t(s, d, "events")
    half = events.agg(F.max("event_id")).first()[0] // 2
    table = versioned(s, "users", "user_id long", "n long, last long", {"n": lambda c, order: F.sum(c), "last": lambda c, order: F.max(c)})
    for part in (events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)):
        table.commit(part.select("user_id", F.lit(1).cast("long").alias("n"), F.col("event_id").cast("long").alias("last")))
    table.compact()
    return table.read(1)
