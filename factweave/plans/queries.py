"""The engine's queries over the test tables, each with SQL that must give the same rows.

Graphs are derived from the tables: embeddings are facts in the scope of their
label; documents are facts in the scope of their source; suppliers, parts,
orders, customers and nations form a causal graph; events are versions of
(user, type) facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import search, store, temporal, walk
from factweave.session import table as t
from factweave.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# derived graphs

def g_vec(s, d):
    return t(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("content"), "vec_id", "embedding", "label")


def g_sup(s, d, repeats=False):
    """Edges from suppliers over parts, orders and customers to nations; with repeats as they are read, without a shuffle."""

    def edges(table, a, src, b, dst):
        keys = t(s, d, table).select(src, dst)
        return (keys if repeats else keys.distinct()).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))

    return (
        edges("lineitem", "s", "l_suppkey", "p", "l_partkey").unionAll(edges("lineitem", "p", "l_partkey", "o", "l_orderkey"))
        .unionAll(edges("orders", "o", "o_orderkey", "c", "o_custkey")).unionAll(edges("customer", "c", "c_custkey", "n", "c_nationkey"))
    )


SUP = """e AS (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 'p'||l_partkey, 'o'||l_orderkey FROM lineitem
 UNION ALL SELECT DISTINCT 'o'||o_orderkey, 'c'||o_custkey FROM orders UNION ALL SELECT DISTINCT 'c'||c_custkey, 'n'||c_nationkey FROM customer)"""
REACH = "r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<4)"


def g_doc(s, d):
    return t(s, d, "documents")


def g_evt(s, d):
    """Facts e<id> with edges from user and type, and causes between consecutive types of a user."""
    ev = t(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.withColumn("next", F.lead("event_type").over(w))
    plain = ev.select(F.col("event_type").alias("src"), F.concat(F.lit("e"), "event_id").alias("dst"), F.lit(None).cast("string").alias("label"))
    onto = ev.where("next is not null").select(F.col("next").alias("src"), F.concat(F.lit("e"), "event_id").alias("dst"), F.lit(None).cast("string").alias("label"))
    return plain.unionAll(onto).unionAll(ev.where("next is not null").select(F.col("event_type").alias("src"), F.col("next").alias("dst"), F.lit("causes").alias("label"))).distinct()


EVT = """n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
e AS (SELECT event_type AS src, 'e'||event_id AS dst, NULL AS label FROM n UNION SELECT nx, 'e'||event_id, NULL FROM n WHERE nx IS NOT NULL UNION SELECT event_type, nx, 'causes' FROM n WHERE nx IS NOT NULL)"""


def first_vector(s, d):
    """The embedding with the smallest id; a zero of one dimension if there is none."""
    row = t(s, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return row[0] if row else [0.0]


COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
NEAR = f"SELECT 'v'||a.vec_id AS content, {COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id=0"


# search

@query(f"{NEAR} ORDER BY score DESC, content LIMIT 10")
def knn_top10(s, d):
    return search.knn(g_vec(s, d), first_vector(s, d), 10)


@query(f"{NEAR} AND a.label IN (1,2) ORDER BY score DESC, content LIMIT 10")
def knn_scoped(s, d):
    return search.knn(g_vec(s, d), first_vector(s, d), 10, F.col("label").isin(1, 2))


@query(f"""SELECT query, content, score, rank FROM (SELECT 'v'||q.vec_id AS query, 'v'||a.vec_id AS content, {COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, 'v'||a.vec_id)::INT AS rank FROM embeddings a, embeddings q WHERE q.vec_id%50=0 AND a.vec_id<>q.vec_id) WHERE rank<=5""")
def knn_join_top5(s, d):
    v = g_vec(s, d)
    return search.knn_join(v.where("vec_id % 50 = 0").withColumnRenamed("content", "query"), v, 5)


@query(f"""SELECT query, content, score FROM (SELECT 'v'||q.vec_id AS query, 'v'||a.vec_id AS content, {COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, 'v'||a.vec_id) AS rank FROM embeddings a, embeddings q WHERE q.vec_id%50=0 AND a.vec_id<>q.vec_id) WHERE rank=1 AND score>=0.25""")
def duplicate_candidates(s, d):
    v = g_vec(s, d)
    return search.knn_join(v.where("vec_id % 50 = 0").withColumnRenamed("content", "query"), v, 1).where("score >= 0.25").select("query", "content", "score")


@query(f"""WITH h AS (SELECT 'v'||a.vec_id AS content, {COS} AS score, a.vec_id::DOUBLE AS ts FROM embeddings a, embeddings q WHERE q.vec_id=0 ORDER BY score DESC, content LIMIT 20)
SELECT content, round(0.7*(score-min(score) OVER())/(max(score) OVER()-min(score) OVER())+0.3*(ts-min(ts) OVER())/(max(ts) OVER()-min(ts) OVER()),6) AS score FROM h""")
def recency_blend(s, d):
    hits = search.knn(g_vec(s, d), first_vector(s, d), 20)
    return search.blend(hits.withColumn("ts", F.substring("content", 2, 20).cast("double")), 0.3)


WORDS = ["the", "and", "trash", "nicht"]
KEY = rf"""w AS (SELECT doc_id, list_intersect(list_distinct(regexp_extract_all(lower(text),'[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')), {WORDS}) AS hit FROM documents),
k AS (SELECT count(*) AS n, {','.join(f"sum(list_contains(hit,'{w}')::INT) AS d{i}" for i, w in enumerate(WORDS))} FROM w),
kw AS (SELECT 'd'||doc_id AS content, round({'+'.join(f"CASE WHEN list_contains(hit,'{w}') THEN ln(1+n/d{i}) ELSE 0 END" for i, w in enumerate(WORDS))},6) AS score FROM w, k WHERE len(hit)>0)"""


def named_docs(s, d):
    return g_doc(s, d).select(F.concat(F.lit("d"), "doc_id").alias("content"), "text")


@query(f"WITH {KEY} SELECT * FROM kw ORDER BY score DESC, content LIMIT 25")
def keyword_idf_top(s, d):
    return search.keyword(named_docs(s, d), WORDS, 25)


FUSE = f"""WITH {KEY}, x AS (SELECT content, row_number() OVER (ORDER BY score DESC, content) AS ra FROM (SELECT replace(content,'v','d') AS content, score FROM ({NEAR}))),
y AS (SELECT content, row_number() OVER (ORDER BY score DESC, content) AS rb FROM kw)"""
WINDOWED = FUSE.replace("FROM kw)", "FROM kw QUALIFY rb<=100)").replace(f"FROM ({NEAR}))))", f"FROM ({NEAR}))) QUALIFY ra<=100)").replace(f"FROM ({NEAR})))", f"FROM ({NEAR})) QUALIFY ra<=100)")


def both_hits(s, d):
    """All embeddings and all keyword hits, each with a score."""
    near = search.scored(g_vec(s, d), first_vector(s, d)).withColumn("content", F.regexp_replace("content", "v", "d"))
    return near, search.keyword(named_docs(s, d), WORDS, None)


@query(FUSE + " SELECT content, round(coalesce(1.0::DOUBLE/(60+ra),0)+coalesce(1.0::DOUBLE/(60+rb),0),9) AS score FROM x FULL JOIN y USING (content)")
def hybrid_rrf(s, d):
    return search.fuse(*both_hits(s, d))


@query(WINDOWED + " SELECT content, round(coalesce(1.0::DOUBLE/(60+ra),1.0::DOUBLE/161)+coalesce(1.0::DOUBLE/(60+rb),1.0::DOUBLE/161),9) AS score FROM x FULL JOIN y USING (content)")
def hybrid_rrf_window(s, d):
    """Both channels as far as their window, for ten results: max(10 * 10, 100)."""
    return search.fuse(*both_hits(s, d), window=100)


@query(FUSE + " SELECT content, round(1.0::DOUBLE/(60+ra)+coalesce(1.0::DOUBLE/(60+rb),0),9) AS score FROM x LEFT JOIN y USING (content) WHERE ra<=30 ORDER BY score DESC, content LIMIT 10")
def hybrid_rrf_left(s, d):
    """Ten of the 30 nearest, keyword ranks added where they have one."""
    return search.fuse(*both_hits(s, d), nearest=30).orderBy(F.desc("score"), "content").limit(10)


FUZZY = ["trash", "nicht", "license"]
DUCK_TRIGRAMS = "list_distinct(list_transform(range(1,len({0})+2), lambda i: substr('  '||{0}||' ', i, 3)))"


@query(rf"""WITH w AS (SELECT DISTINCT 'd'||doc_id AS content, unnest(regexp_extract_all(lower(text),'[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')) AS word FROM documents),
v AS (SELECT word, q, {DUCK_TRIGRAMS.format("word")} AS t, {DUCK_TRIGRAMS.format("q")} AS u FROM (SELECT DISTINCT word FROM w), (SELECT unnest({FUZZY}) AS q)),
h AS (SELECT DISTINCT content, q FROM w JOIN v USING (word) WHERE len(list_intersect(t,u))::DOUBLE/len(list_distinct(t||u))>=0.45),
f AS (SELECT q, count(*) AS df FROM h GROUP BY q)
SELECT content, round(sum(ln(1+(SELECT count(*) FROM documents)/df)),6) AS score FROM h JOIN f USING (q) GROUP BY content ORDER BY score DESC, content LIMIT 25""")
def keyword_fuzzy_top(s, d):
    return search.fuzzy_keyword(named_docs(s, d), FUZZY, 25)


@query("SELECT 'd'||doc_id AS content FROM documents WHERE contains(lower(text), 'of the')")
def keyword_phrase(s, d):
    return search.phrase(named_docs(s, d), "of the")


# text

@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name,' ')) AS w FROM part), g AS (SELECT w, list_distinct(list_transform(range(1,len(w)+2), lambda i: substr('  '||lower(w)||' ', i, 3))) AS t FROM w)
SELECT a.w AS a, b.w AS b, round(len(list_intersect(a.t,b.t))::DOUBLE/len(list_distinct(a.t||b.t)),6) AS score FROM g a JOIN g b ON a.w<b.w WHERE len(list_intersect(a.t,b.t))::DOUBLE/len(list_distinct(a.t||b.t))>=0.1""")
def word_trigram_match(s, d):
    vocabulary = t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().withColumn("t", X.trigrams(F.col("w")))
    # a pair must share a trigram, so it is joined on one
    grams = vocabulary.select("w", "t", F.explode("t").alias("g"))
    pairs = grams.alias("x").join(grams.alias("y"), F.expr("x.g = y.g and x.w < y.w")).select(F.col("x.w").alias("a"), F.col("y.w").alias("b"), F.col("x.t").alias("s"), F.col("y.t").alias("t")).distinct()
    return pairs.withColumn("score", X.jaccard(F.col("s"), F.col("t"))).where("score >= 0.1").select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT doc_id, greatest(1, (length(text)+3)//4)::BIGINT AS tokens FROM documents")
def approx_tokens(s, d):
    return g_doc(s, d).select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


SENTENCES = "regexp_replace({0}, '\\n+', chr(10), 'g')"
for _pattern, _new in X.SENTENCE_RULES:
    SENTENCES = "regexp_replace(" + SENTENCES + ", '" + _pattern.replace("'", "''") + "', '" + _new.replace("$", "\\") + "', 'g')"
SENTENCES = "list_filter(list_transform(string_split(replace(" + SENTENCES.replace("{L}", "{{L}}").replace("{N}", "{{N}}") + ", chr(1), chr(10)), chr(10)), lambda x: trim(x)), lambda x: length(x)>0)"


@query(f"SELECT conv_id, turn, len({SENTENCES.format('text')})::BIGINT AS n FROM conversations")
def sentence_split_counts(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(f"""SELECT c_custkey, CASE WHEN length(r)>0 THEN r ELSE p END AS name FROM (SELECT c_custkey, p, trim(regexp_replace(p, '(?i)([,\\s]+({'|'.join(x.replace('.', chr(92) + '.') for x in X.SUFFIXES)})\\.?)+$', '')) AS r
FROM (SELECT c_custkey, trim(regexp_replace(c_name||'  Group, Co., Ltd.','\\s+',' ','g')) AS p FROM customer))""")
def canonical_names(s, d):
    return t(s, d, "customer").select("c_custkey", X.canonical(F.concat("c_name", F.lit("  Group, Co., Ltd."))).alias("name"))


BACK = """(regexp_matches(lower(trim({0})), '^({1})([^\\p{{L}}\\p{{N}}]|$)') OR (regexp_matches(lower(trim({0})), '^({2})([^\\p{{L}}\\p{{N}}]|$)') AND regexp_matches(lower(trim({0})), '({3})')))"""
_flat = lambda table: "|".join(p.replace("'", "''") for held in table.values() for p in held)
BACK = BACK.replace("{1}", _flat(X.POINTING_CONNECTIVES)).replace("{2}", _flat(X.DEICTICS)).replace("{3}", _flat(X.CAUSAL_VERBS))


@query(f"""SELECT conv_id, turn, pv AS previous FROM (SELECT conv_id, turn, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM conversations) WHERE pv IS NOT NULL AND {BACK.format('text')}""")
def backref_pairs(s, d):
    c = t(s, d, "conversations").withColumn("previous", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("previous").isNotNull() & X.back_referenced_cause(F.col("text"))).select("conv_id", "turn", "previous")


def duck_quoted(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BRIDGE = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '\\p{{L}}+'), lambda w: (length(w)>=4 OR (length(w)=3 AND upper(w)=w AND lower(w)<>w)) AND NOT list_contains(STOP, lower(w))), lambda w: substr(lower(w),1,5)))".replace("STOP", duck_quoted(X.BRIDGE_STOP))


@query(f"""WITH w AS (SELECT doc_id, {BRIDGE.format('text')} AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT t AS u FROM w WHERE doc_id=(SELECT min(doc_id) FROM w))
SELECT doc_id, len(list_intersect(t, u))::BIGINT AS shared FROM w, q WHERE len(list_intersect(t, u))>0""")
def bridge_tokens_overlap(s, d):
    w = t(s, d, "documents").where("text is not null").select("doc_id", X.bridge_tokens(F.col("text")).alias("t"))
    one = w.orderBy("doc_id").limit(1).select(F.col("t").alias("u"))
    return w.crossJoin(F.broadcast(one)).select("doc_id", F.size(F.array_intersect("t", "u")).cast("long").alias("shared")).where("shared > 0")


TAGS = {"view": "B-LOOK", "click": "I-LOOK", "purchase": "B-BUY"}


@query("""WITH x AS (SELECT user_id AS text_id, event_id AS pos, event_id*10 AS low, event_id*10+9 AS high, CASE event_type WHEN 'view' THEN 'B-LOOK' WHEN 'click' THEN 'I-LOOK' WHEN 'purchase' THEN 'B-BUY' ELSE 'O' END AS tag FROM events),
y AS (SELECT *, substr(tag,3) AS kind, (starts_with(tag,'B-') OR (starts_with(tag,'I-') AND NOT coalesce(substr(lag(tag) OVER w,3)=substr(tag,3), false)))::INT AS fresh FROM x WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY text_id ORDER BY pos) AS span FROM y) SELECT text_id, kind, min(low) AS low, max(high) AS high FROM z WHERE tag<>'O' GROUP BY text_id, span, kind""")
def bio_decode(s, d):
    """Spans of users' events, whose types stand for token tags."""
    ev = t(s, d, "events")
    tag = F.lit("O")
    for kind, name in TAGS.items():
        tag = F.when(F.col("event_type") == kind, name).otherwise(tag)
    return X.bio_decode(ev.select(F.col("user_id").alias("text_id"), F.col("event_id").alias("pos"), tag.alias("tag"), (F.col("event_id") * 10).alias("low"), (F.col("event_id") * 10 + 9).alias("high")))


# store

@query("SELECT text AS content, min(doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)),',') AS scopes FROM documents GROUP BY text")
def upsert_union_scopes(s, d):
    rows = g_doc(s, d).select(F.col("text").alias("content"), "doc_id", F.array("source").alias("scopes"), F.col("doc_id").alias("seq"))
    merged = store.upsert_nodes(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), first=("doc_id",))
    return merged.select("content", "doc_id", F.concat_ws(",", "scopes").alias("scopes"))


@query("""SELECT 'u'||user_id AS src, event_type AS dst, arg_max(label, event_id) FILTER (label IS NOT NULL) AS label FROM
(SELECT *, CASE WHEN event_id%3=0 THEN 'l'||(event_id%7) END AS label FROM events) GROUP BY ALL""")
def edge_label_merge(s, d):
    e = t(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("l"), F.col("event_id") % 7)).alias("label"), F.col("event_id").alias("seq"))
    return store.merge_edges(e)


@query(f"WITH {SUP} SELECT src, dst FROM e WHERE src NOT IN (SELECT 'p'||p_partkey FROM part WHERE p_size>25) AND dst NOT IN (SELECT 'p'||p_partkey FROM part WHERE p_size>25)")
def delete_cascade(s, d):
    gone = t(s, d, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("content"))
    return store.delete_nodes(gone, g_sup(s, d), gone)[1]


@query("SELECT 'p'||p_partkey AS content, 'part' AS kind FROM part WHERE p_size<=25 UNION ALL SELECT 's'||s_suppkey, 'supplier' FROM supplier")
def delete_nodes_left(s, d):
    parts = t(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("content"), F.lit("part").alias("kind"), "p_size")
    nodes = parts.drop("p_size").unionAll(t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("supplier")))
    return store.delete_nodes(nodes, g_sup(s, d), parts.where("p_size > 25"))[0]


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_quantity>=45)")
def orphan_purge(s, d):
    line = t(s, d, "lineitem").where("l_quantity >= 45")
    edges = line.select(F.col("l_partkey").alias("src"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("dst"))
    return store.orphans(t(s, d, "part").select(F.col("p_partkey").cast("string").alias("content")), edges.select(F.col("dst").alias("content")), edges.select(F.col("src").cast("string").alias("src"), "dst")).select(F.col("content").cast("long").alias("p_partkey"))


@query("SELECT user_id AS content, bool_and(event_type IN ('click','view')) AS deleted FROM events GROUP BY user_id HAVING bool_or(event_type IN ('click','view'))")
def forget_scopes(s, d):
    return store.forget(t(s, d, "events").select(F.col("user_id").alias("content"), F.col("event_type").alias("scope")), ["click", "view"])


@query("SELECT user_id, max(ts) AS last_accessed FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 2 DAY")
def stale_nodes(s, d):
    seen = t(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_accessed"))
    return store.stale(seen, F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'"), 2)


@query("SELECT DISTINCT source AS scope FROM documents WHERE starts_with(source,'src1')")
def scope_list(s, d):
    return store.list_scopes(g_doc(s, d).select(F.col("source").alias("scope")), "src1")


@query("SELECT (SELECT count(DISTINCT text) FROM documents) AS facts, (SELECT count(DISTINCT lang) FROM documents) AS entities, (SELECT count(*) FROM (SELECT DISTINCT lang, text FROM documents)) AS edges, (SELECT count(DISTINCT source) FROM documents) AS sessions")
def graph_stats(s, d):
    return g_doc(s, d).agg(F.countDistinct("text").alias("facts"), F.countDistinct("lang").alias("entities"), F.countDistinct("lang", "text").alias("edges"), F.countDistinct("source").alias("sessions"))


@query("SELECT 'v'||vec_id AS content, label FROM embeddings WHERE vec_id%50=0")
def lookup_types(s, d):
    v = g_vec(s, d)
    return store.lookup(v, v.where("vec_id % 50 = 0"), "label")


@query(f"WITH {EVT} SELECT DISTINCT a.dst AS fact, c.src AS cause, c.dst AS effect FROM e c JOIN e a ON a.src=c.src AND a.label IS NULL JOIN e b ON b.src=c.dst AND b.dst=a.dst AND b.label IS NULL WHERE c.label='causes'")
def causal_relations(s, d):
    return store.causal_relations(g_evt(s, d))


# neighbours and walks

@query(f"""WITH {EVT}, a AS (SELECT src, dst AS nbr, label, 'out' AS direction FROM e UNION ALL SELECT dst, src, label, 'in' FROM e WHERE src<>dst)
SELECT src, nbr, label, direction FROM (SELECT *, row_number() OVER (PARTITION BY src, nbr ORDER BY label IS NULL, direction DESC, label) AS n FROM a) WHERE n=1""")
def neighbours_dedup(s, d):
    return walk.neighbours(g_evt(s, d))


@query("""SELECT 'p'||l_partkey AS src, 'o'||l_orderkey AS nbr, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, 'o'||l_orderkey)::INT AS rank FROM
(SELECT l_partkey, l_orderkey, max(l_quantity) AS score FROM lineitem GROUP BY ALL)) WHERE rank<=3""")
def neighbours_topk_per_source(s, d):
    line = t(s, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").alias("score"))
    return walk.nearest(line.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("nbr"), "score"), 3)


def start(s, name="s0"):
    return s.createDataFrame([(name,)], "node string")


@query(f"WITH RECURSIVE {SUP}, {REACH} SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def discover_bfs(s, d):
    return walk.reach(walk.held(g_sup(s, d)), start(s), 4).select("node", "depth")


@query(f"""WITH RECURSIVE {SUP}, r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<2),
p1 AS (SELECT e.dst AS node, min(e.src) AS parent FROM r JOIN e ON e.src=r.node WHERE r.depth=0 GROUP BY 1), p2 AS (SELECT e.dst AS node, min(e.src) AS parent FROM r JOIN e ON e.src=r.node WHERE r.depth=1 GROUP BY 1)
SELECT 's0' AS node, 0 AS depth, 's0' AS path UNION ALL SELECT node, 1, 's0>'||node FROM p1 UNION ALL SELECT node, 2, 's0>'||parent||'>'||node FROM p2""")
def discover_paths(s, d):
    return walk.paths(walk.reach(walk.held(g_sup(s, d)), start(s), 2), 2).select("node", "depth", F.concat_ws(">", "path").alias("path"))


@query(f"""WITH RECURSIVE {SUP}, r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<4 AND (e.dst[1]<>'o' OR right(e.dst,1)='0')) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def walk_isolated(s, d):
    return walk.reach(g_sup(s, d), start(s), 4, ~F.col("dst").startswith("o") | F.col("dst").endswith("0")).select("node", "depth")


@query(f"WITH RECURSIVE {SUP}, {REACH} SELECT DISTINCT e.src AS cause, e.dst AS effect, (r.depth+1)::INT AS depth FROM r JOIN e ON e.src=r.node WHERE r.depth<4")
def trace_effects(s, d):
    edges = walk.held(g_sup(s, d))
    return walk.hops(edges, walk.reach(edges, start(s), 4), 4)


@query(f"""WITH RECURSIVE {SUP}, r AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT e.src, r.depth+1 FROM r JOIN e ON e.dst=r.node WHERE r.depth<3) SELECT node, min(depth)::INT AS depth FROM r WHERE depth>0 AND node NOT IN (SELECT dst FROM e) GROUP BY node""")
def root_causes(s, d):
    back = walk.reverse(g_sup(s, d, repeats=True))
    return walk.terminals(back, walk.reach(back, start(s, "c1"), 3))


@query(f"WITH RECURSIVE {SUP}, {REACH} SELECT DISTINCT e.src AS cause, e.dst AS effect FROM r JOIN e ON e.src=r.node WHERE r.depth<3 AND e.dst='c1'")
def causal_chain_last_hops(s, d):
    edges = walk.held(g_sup(s, d))
    return walk.hops(edges, walk.reach(edges, start(s), 3), 3).where("effect = 'c1'").select("cause", "effect")


@query(f"""WITH RECURSIVE {SUP}, q AS (SELECT 'p'||p_partkey AS a, 'p'||(p_partkey+1) AS b FROM part WHERE p_partkey%10=0), t AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
st AS (SELECT src, dst, 1 AS cost FROM e UNION ALL SELECT a, b, 0 FROM t), r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT st.dst, r.depth+st.cost FROM r JOIN st ON st.src=r.node WHERE r.depth+st.cost<=2)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def walk_same_as(s, d):
    ties = t(s, d, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("a"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("b"))
    return walk.reach_with_aliases(walk.held(g_sup(s, d)), ties, start(s), 2).select("node", "depth")


@query(f"""WITH RECURSIVE {SUP}, m AS (SELECT src, dst, 1 AS f, 0 AS b FROM e UNION ALL SELECT dst, src, 0, 1 FROM e),
r AS (SELECT 's0' AS node, 0 AS forward, 0 AS backward UNION SELECT m.dst, r.forward+m.f, r.backward+m.b FROM r JOIN m ON m.src=r.node WHERE r.forward+m.f<=1 AND r.backward+m.b<=1)
SELECT node, forward, backward FROM r WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.node=r.node AND y.forward<=r.forward AND y.backward<=r.backward AND y.forward+y.backward<r.forward+r.backward)""")
def walk_step_budgets(s, d):
    return walk.budgeted(g_sup(s, d, repeats=True), start(s), 1, 1)


@query(f"""WITH {SUP}, m AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), z AS (SELECT 's0' AS node),
a AS (SELECT node FROM (SELECT DISTINCT m.dst AS node FROM z JOIN m ON m.src=z.node) WHERE node NOT IN (SELECT node FROM z) ORDER BY substr(node,2)::DOUBLE DESC, node LIMIT 5),
b AS (SELECT node FROM (SELECT DISTINCT m.dst AS node FROM a JOIN m ON m.src=a.node) WHERE node NOT IN (SELECT node FROM z UNION SELECT node FROM a) ORDER BY substr(node,2)::DOUBLE DESC, node LIMIT 5)
SELECT node, 0 AS round FROM z UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b""")
def walk_reranked(s, d):
    edges = g_sup(s, d, repeats=True)
    scores = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).withColumn("score", F.substring("node", 2, 20).cast("double"))
    return walk.reranked(edges, scores, start(s), 3, 5)


@query(f"""WITH RECURSIVE {SUP}, q AS (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst, l_returnflag AS fact FROM lineitem), cut AS (SELECT src, dst FROM q GROUP BY ALL HAVING bool_and(fact='N')),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.src=e.src AND cut.dst=e.dst)), r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<2),
z AS (SELECT 's0' AS node, 0 AS depth UNION SELECT k.dst, z.depth+1 FROM z JOIN k ON k.src=z.node WHERE z.depth<2) SELECT node, min(depth)::INT AS depth FROM r WHERE node NOT IN (SELECT node FROM z) GROUP BY node""")
def what_if_collapse(s, d):
    line = t(s, d, "lineitem")
    support = line.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("fact"))
    return walk.collapsed(g_sup(s, d, repeats=True), support, s.createDataFrame([("N",)], "fact string"), start(s), 2)


# time

def g_time(s, d):
    return temporal.versions(t(s, d, "events"), ["user_id", "event_type"], "ts", "event_id")


TIME = "v AS (SELECT *, lead(ts) OVER w AS nx, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"


@query(f"WITH {TIME} SELECT event_id, user_id, event_type FROM v WHERE ts<=TIMESTAMP '2024-01-15' AND (nx IS NULL OR nx>TIMESTAMP '2024-01-15')")
def as_of_facts(s, d):
    return store.valid_at(g_time(s, d), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")).select("event_id", "user_id", "event_type")


@query(f"WITH {TIME} SELECT event_id, user_id, event_type FROM v WHERE nx IS NULL")
def current_facts(s, d):
    return g_time(s, d).where("invalid_at is null").select("event_id", "user_id", "event_type")


@query(f"WITH {TIME} SELECT event_id, previous AS supersedes, next AS superseded_by FROM v")
def supersession_history(s, d):
    return g_time(s, d).select("event_id", F.col("previous").alias("supersedes"), F.col("next").alias("superseded_by"))


@query("SELECT event_type AS src, nx AS dst, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL GROUP BY ALL")
def transition_counts(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT conv_id, turn, greatest(1,(length(text)+3)//4)::BIGINT AS tokens FROM conversations), y AS (SELECT *, (sum(tokens) OVER w)::BIGINT AS running, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, tokens, running, running<=200 OR n=1 AS kept FROM y""")
def fold_history(s, d):
    return temporal.fold(t(s, d, "conversations"), "conv_id", "turn", 200).select("conv_id", "turn", "tokens", "running", "kept")


@query("SELECT event_type, quantile_cont(value,0.5) AS p50, quantile_cont(value,0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events WHERE event_id%2=0 GROUP BY 1), h AS (SELECT user_id, list(DISTINCT event_type) AS b FROM events WHERE event_id%2=1 GROUP BY 1)
SELECT user_id, round(len(list_intersect(a,b))::DOUBLE/len(a),6) AS recall, round(len(list_intersect(a,b))::DOUBLE/len(b),6) AS precision FROM g JOIN h USING (user_id)""")
def chain_metrics(s, d):
    ev = t(s, d, "events")
    both = ev.where("event_id % 2 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).join(ev.where("event_id % 2 = 1").groupBy("user_id").agg(F.collect_set("event_type").alias("b")), "user_id")
    hit = F.size(F.array_intersect("a", "b")).cast("double")
    return both.select("user_id", F.round(hit / F.size("a"), 6).alias("recall"), F.round(hit / F.size("b"), 6).alias("precision"))


# streams

def events_stream(s, d):
    """Reads the events as a stream of files; a pattern, since the table may be one file."""
    schema = t(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_upsert(s, d):
    stream = events_stream(s, d).select("user_id", "ts", "event_id")
    return ingest.upsert(stream, "user_id", "ts", ingest.shared_folder(s, "upsert")).select("user_id", "event_id")
