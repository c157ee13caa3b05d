"""More queries: lookups, writes, ingest, causal pieces, and the graph's own questions over conversations.

Conversations are facts of their sessions; embeddings stand for spans, whose label
says whether they are causes (even) or effects (odd).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import facts, ingest, search, store, walk
from factweave.plans.queries import COS, ORACLE, QUERIES, SENTENCES, SUP, TIME, duck_quoted, g_doc, g_sup, g_time, g_vec, named_docs, query, start
from factweave.session import table as t

__all__ = ["ORACLE", "QUERIES"]

DOC_NODES = "SELECT text AS content, 'text' AS type, list_sort(list(DISTINCT source)) AS scopes FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT lang, 'entity', list_sort(list(DISTINCT source)) FROM documents WHERE lang IS NOT NULL GROUP BY lang"


def doc_nodes(s, d) -> DataFrame:
    """Texts as facts and languages as entities, in the scopes of their sources."""
    g = g_doc(s, d)
    one = lambda c, kind: g.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("content")).agg(F.lit(kind).alias("type"), F.array_sort(F.collect_set("source")).alias("scopes"))
    return one("text", "text").unionByName(one("lang", "entity"))


def joined(column: str):
    return F.concat_ws(",", column).alias(column)


# lookups

@query(f"WITH n AS ({DOC_NODES}) SELECT md5(content) AS content, array_to_string(scopes, ',') AS scopes FROM n WHERE content IN (SELECT text FROM documents WHERE doc_id%50=0)")
def lookup_scopes(s, d):
    keys = g_doc(s, d).where("doc_id % 50 = 0").select(F.col("text").alias("content"))
    return store.scopes_of(store.node_scopes(doc_nodes(s, d)), keys).select(F.md5("content").alias("content"), joined("scopes"))


@query(f"WITH {TIME} SELECT event_id AS content, ts AS created_at, nx AS invalid_at FROM v WHERE event_id%50=0")
def lookup_validity(s, d):
    nodes = g_time(s, d).withColumn("content", F.col("event_id"))
    return store.lookup(nodes, nodes.where("event_id % 50 = 0"), "created_at", "invalid_at")


@query(f"WITH n AS ({DOC_NODES}) SELECT count(*) AS n FROM n WHERE type='text' AND list_has_any(scopes, ['src1','src2'])")
def count_nodes_filtered(s, d):
    return store.count_nodes(doc_nodes(s, d), "text", ["src1", "src2"])


@query(f"WITH {SUP} SELECT count(*) AS n FROM e")
def count_edges(s, d):
    return g_sup(s, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_name AS content FROM part WHERE lower(p_name)='red' OR starts_with(lower(p_name), 'red ') ORDER BY content LIMIT 20")
def entities_starting_with(s, d):
    return store.starting_with(t(s, d, "part").select(F.col("p_name").alias("content"), F.lit("entity").alias("type")).distinct(), "Red")


@query(f"WITH n AS ({DOC_NODES}) SELECT md5(content) AS content FROM n WHERE list_has_any(scopes, ['src3','src4'])")
def nodes_in_scopes(s, d):
    return store.in_scopes(store.node_scopes(doc_nodes(s, d)), ["src3", "src4"]).select(F.md5("content").alias("content"))


@query(f"WITH n AS ({DOC_NODES}) SELECT type, count(*) AS n FROM n WHERE list_has_any(scopes, ['src5']) GROUP BY type")
def nodes_by_type_in_scope(s, d):
    return store.chosen(doc_nodes(s, d), scopes=["src5"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# writes

@query("""WITH o AS (SELECT user_id, min(event_id) AS first_id, count(*) FILTER (event_id%3=0) AS n_new, count(*) FILTER (event_id%3<>0) AS n_old, max(ts) FILTER (event_id%3<>0) AS accessed,
arg_min(event_type, event_id) FILTER (event_id%3<>0) AS old_type, arg_min(event_type, event_id) FILTER (event_id%3=0) AS new_type FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS content, coalesce(old_type, new_type) AS type, n_new>0 AS touched, n_new=0 AS retired FROM o""")
def insert_revives(s, d):
    """Users' first events are nodes that were all retired; a third of the events asserts some of them again."""
    ev = t(s, d, "events").select(F.col("user_id").cast("string").alias("content"), F.col("event_type").alias("type"), F.array(F.lit(0.0).cast("float")).alias("embedding"), F.col("ts").cast("timestamp").alias("created_at"), F.array("event_type").alias("scopes"), F.col("event_id").alias("seq"))
    old = ev.where("seq % 3 <> 0").groupBy("content").agg(F.min_by("type", "seq").alias("type"), F.first("embedding").alias("embedding"), F.min("created_at").alias("created_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("scopes")))).alias("scopes"))
    old = old.select("content", "type", "embedding", "created_at", F.col("created_at").alias("last_accessed"), "scopes", F.lit("2030-01-01").cast("timestamp").alias("invalid_at"))
    now = F.lit("2031-01-01").cast("timestamp")
    out = store.insert_nodes(old, ev.where("seq % 3 = 0"), now)
    return out.select("content", "type", (F.col("last_accessed") == now).alias("touched"), F.col("invalid_at").isNotNull().alias("retired"))


@query("""WITH g AS (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY) SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM g)""")
def stale_cascade(s, d):
    """The edges from users to event types that are left when stale users are deleted."""
    ev = t(s, d, "events")
    nodes = ev.groupBy("user_id").agg(F.max("ts").alias("last_accessed")).select(F.col("user_id").cast("string").alias("content"), "last_accessed")
    gone = store.stale(nodes, F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'"), 2)
    edges = ev.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")).distinct()
    return store.delete_nodes(nodes, edges, gone)[1].select(F.col("src").cast("long").alias("user_id"), F.col("dst").alias("event_type"))


@query("""WITH m AS (SELECT user_id, bool_and(event_type IN ('click','view')) AS gone FROM events GROUP BY user_id HAVING bool_or(event_type IN ('click','view')))
SELECT count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS detached FROM m""")
def forget_counts(s, d):
    marks = store.forget(t(s, d, "events").select(F.col("user_id").alias("content"), F.col("event_type").alias("scope")), ["click", "view"])
    return marks.agg(F.count_if("deleted").alias("deleted"), F.count_if(~F.col("deleted")).alias("detached"))


USERS = "SELECT user_id, list_sort(list(DISTINCT event_type)) AS scopes FROM events GROUP BY user_id"


def user_nodes(s, d) -> DataFrame:
    return t(s, d, "events").groupBy(F.col("user_id").cast("string").alias("content")).agg(F.array_sort(F.collect_set("event_type")).alias("scopes"))


@query(f"WITH n AS ({USERS}) SELECT user_id::VARCHAR AS content, array_to_string(CASE WHEN user_id%2=0 THEN list_filter(scopes, lambda x: x<>'click') ELSE scopes END, ',') AS scopes FROM n")
def remove_scopes(s, d):
    nodes = user_nodes(s, d)
    return store.remove_scopes(nodes, nodes.where("cast(content as long) % 2 = 0"), ["click"])[0].select("content", joined("scopes"))


@query(f"WITH n AS ({USERS}) SELECT user_id::VARCHAR AS content, 'click' AS scope FROM n WHERE user_id%2=0 AND list_contains(scopes,'click')")
def removed_scopes(s, d):
    nodes = user_nodes(s, d)
    return store.remove_scopes(nodes, nodes.where("cast(content as long) % 2 = 0"), ["click"])[1]


@query(f"WITH n AS ({USERS}) SELECT user_id::VARCHAR AS content, user_id%5=0 AS retired FROM n")
def set_invalid(s, d):
    nodes = user_nodes(s, d).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    keys = nodes.where("cast(content as long) % 5 = 0").select("content").unionAll(s.createDataFrame([("nobody",)], "content string"))
    return store.set_invalid(nodes, keys, F.lit("2024-01-01").cast("timestamp")).select("content", F.col("invalid_at").isNotNull().alias("retired"))


@query(f"""WITH {TIME}, p AS (SELECT event_id AS src, previous AS dst FROM v WHERE previous IS NOT NULL), k AS (SELECT event_id AS content FROM events WHERE event_id%50=0)
SELECT content::VARCHAR AS content, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst::VARCHAR) FROM p WHERE src=content),'') AS supersedes, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src::VARCHAR) FROM p WHERE dst=content),'') AS superseded_by FROM k""")
def supersedes_edges(s, d):
    g = g_time(s, d)
    edges = g.where("previous is not null").select(F.col("event_id").cast("string").alias("src"), F.col("previous").cast("string").alias("dst"), F.lit("supersedes").alias("label"))
    return store.supersession(edges, g.where("event_id % 50 = 0").select(F.col("event_id").cast("string").alias("content"))).select("content", joined("supersedes"), joined("superseded_by"))


@query(f"WITH {TIME} SELECT event_id FROM v WHERE nx IS NOT NULL AND event_id%50=0")
def superseded_subset(s, d):
    g = g_time(s, d).withColumn("content", F.col("event_id"))
    return store.lookup(g.where("invalid_at is not null"), g.where("event_id % 50 = 0"), "event_id").select("event_id")


# flags and small pieces

@query(f"WITH n AS ({DOC_NODES}) SELECT md5(content) AS content, NOT list_has_any(scopes, ['src1','src7']) AS cross_session FROM n WHERE type='text'")
def cross_session(s, d):
    return doc_nodes(s, d).where("type = 'text'").select(F.md5("content").alias("content"), facts.cross_session(F.col("scopes"), ["src1", "src7"]).alias("cross_session"))


@query("""WITH n AS (SELECT conv_id, list(DISTINCT 't/c'||(conv_id%7)) || CASE WHEN conv_id%3=0 THEN ['t'] WHEN conv_id%3=1 THEN ['x'] ELSE [] END AS scopes FROM conversations GROUP BY conv_id)
SELECT conv_id, conv_id%7=3 AND conv_id%3<>1 AS own FROM n""")
def own_turns(s, d):
    scopes = F.concat(F.array(F.concat(F.lit("t/c"), F.col("conv_id") % 7)), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("t"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return t(s, d, "conversations").select("conv_id").distinct().select("conv_id", facts.own_turn(scopes, "c3").alias("own"))


@query(f"SELECT conv_id, turn, regexp_matches(lower(trim(text)), '(\\?\\s*$)|(^({'|'.join(X.QUESTION_WORDS)})\\b)') AS question FROM conversations WHERE text IS NOT NULL")
def questions(s, d):
    return t(s, d, "conversations").where("text is not null").select("conv_id", "turn", X.is_question(F.col("text")).alias("question"))


@query("SELECT event_id, CASE WHEN event_id%3=2 THEN NULL WHEN event_id%3=1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS at FROM events")
def parsed_times(s, d):
    """Times with Z, with an offset of two hours, and none."""
    ev, text = t(s, d, "events"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("+02:00"))).otherwise(F.lit("yesterday"))
    return ev.select("event_id", X.parsed_time(given).alias("at"))


@query("""WITH h AS (SELECT event_type||(event_id%40) AS content, event_id AS seq, value AS score FROM events), o AS (SELECT content, arg_min(score, seq) AS score, min(seq) AS seq FROM h GROUP BY content)
SELECT content, score, seq FROM o ORDER BY score DESC, seq LIMIT 15""")
def rerank_first(s, d):
    hits = t(s, d, "events").select(F.concat("event_type", F.col("event_id") % 40).alias("content"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return facts.reranked(hits, 15).select("content", "score", "seq")


@query("""WITH r AS (SELECT CASE WHEN event_id%2=0 THEN upper(event_type) ELSE event_type END AS head, 'u'||(user_id%9) AS tail, value AS score FROM events)
SELECT lower(head) AS head, tail, max(score) AS score FROM r GROUP BY 1, 2""")
def best_relations(s, d):
    ev = t(s, d, "events")
    rows = ev.select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("head"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("tail"), F.col("value").alias("score"))
    return facts.best_relations(rows).select(F.lower("head").alias("head"), "tail", "score")


@query("""WITH c AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS found FROM events GROUP BY user_id), w AS (SELECT user_id, found, ['view','click','purchase','view'] AS wanted FROM c),
m1 AS (SELECT user_id, found, wanted, list_position(found,'view') AS a FROM w),
m2 AS (SELECT *, list_position(found[coalesce(a,0)+1:], 'click') AS b FROM m1), m3 AS (SELECT *, coalesce(a,0)+coalesce(b,0) AS ab FROM m2),
m4 AS (SELECT *, list_position(found[ab+1:], 'purchase') AS c FROM m3), m5 AS (SELECT *, ab+coalesce(c,0) AS abc FROM m4), m6 AS (SELECT *, list_position(found[abc+1:], 'view') AS e FROM m5)
SELECT user_id, len(list_intersect(list_distinct(wanted), list_distinct(found)))=3 AS complete, round(len(list_intersect(list_distinct(wanted), list_distinct(found)))/3.0::DOUBLE,6) AS recall,
round(len(list_intersect(list_distinct(wanted), list_distinct(found)))::DOUBLE/len(list_distinct(found)),6) AS precision, round(((coalesce(a,0)>0)::INT+(coalesce(b,0)>0)::INT+(coalesce(c,0)>0)::INT+(coalesce(e,0)>0)::INT)/4.0::DOUBLE,6) AS in_order FROM m6""")
def chain_measures(s, d):
    found = t(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("found"))
    cases = found.select(F.col("user_id").alias("case"), F.array(*map(F.lit, ("view", "click", "purchase", "view"))).alias("wanted"), "found")
    return facts.chain_measures(cases).withColumnRenamed("case", "user_id")


@query("SELECT conv_id, turn, used, used<=900 AS kept FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS used FROM conversations)")
def character_budget(s, d):
    return facts.within_characters(t(s, d, "conversations"), "conv_id", "turn", "text", 900).select("conv_id", "turn", "used", "kept")


@query("""WITH x AS (SELECT conv_id, turn, role, greatest(1,(length(text)+3)//4)::BIGINT AS tokens FROM conversations), y AS (SELECT *, sum(tokens) OVER w AS running, count(*) OVER w AS n, max((role='system')::INT) OVER w AS ended FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (running<=200 OR n=1) AND ended=0 AS kept FROM y) SELECT conv_id, turn, kept OR coalesce(role='user' AND lead(kept) OVER p AND lead(role) OVER p='assistant', false) AS kept FROM k WINDOW p AS (PARTITION BY conv_id ORDER BY turn)""")
def fold_with_questions(s, d):
    from factweave.operators import temporal

    return temporal.fold(t(s, d, "conversations"), "conv_id", "turn", 200, role="role").select("conv_id", "turn", "kept")


@query("""WITH a AS (SELECT 'd'||doc_id AS content, doc_id AS seq FROM documents WHERE doc_id%7=0 ORDER BY doc_id LIMIT 6), b AS (SELECT 'd'||doc_id AS content, doc_id AS seq FROM documents WHERE doc_id%2=0 ORDER BY doc_id LIMIT 20),
u AS (SELECT content, 0 AS part, seq FROM a UNION ALL SELECT content, 1, seq FROM b), o AS (SELECT content, min((part, seq)) AS x FROM u GROUP BY content) SELECT content FROM o ORDER BY x, content LIMIT 10""")
def merge_fill(s, d):
    """Walk results first, then the nearest, ten together."""
    g = g_doc(s, d).select(F.concat(F.lit("d"), "doc_id").alias("content"), F.col("doc_id").alias("seq"))
    return search.fill(g.where("seq % 7 = 0").orderBy("seq").limit(6), g.where("seq % 2 = 0").orderBy("seq").limit(20), 10).select("content")


# ingest

@query(f"SELECT conv_id, turn, unnest(range(len(s)))::INT AS place, unnest(s) AS text FROM (SELECT conv_id, turn, CASE WHEN len(x)>0 THEN x ELSE [text] END AS s FROM (SELECT conv_id, turn, text, {SENTENCES.format('text')} AS x FROM conversations))")
def ingest_sentences(s, d):
    rows = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.array().cast("array<string>").alias("scopes"))
    return ingest.split(rows).select(F.floor(F.col("input") / 1000).alias("conv_id"), (F.col("input") % 1000).alias("turn"), "place", "text")


ENTITIES = f"list_distinct(list_filter(regexp_extract_all({{0}}, '\\p{{{{Lu}}}}[\\p{{{{L}}}}\\p{{{{N}}}}''’-]+(?: \\p{{{{Lu}}}}[\\p{{{{L}}}}\\p{{{{N}}}}''’-]+)*'), lambda x: NOT list_contains({duck_quoted(X.BRIDGE_STOP)}, lower(x))))"


def conversation_texts(s, d) -> DataFrame:
    return t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.array(F.concat(F.lit("c"), "conv_id")).alias("scopes"))


@query(f"SELECT conv_id*1000+turn AS seq, unnest({ENTITIES.format('text')}) AS entity FROM conversations")
def ingest_entities(s, d):
    return ingest.entities(conversation_texts(s, d)).select("seq", "entity")


@query(f"""WITH t AS (SELECT conv_id, text, {ENTITIES.format('text')} AS es FROM conversations WHERE text IS NOT NULL), n AS (SELECT text AS content, 'text' AS type, 'c'||conv_id AS scope, 0 AS o FROM t UNION ALL SELECT unnest(es), 'entity', 'c'||conv_id, 1 FROM t)
SELECT type, count(*) AS nodes, sum(k)::BIGINT AS scopes FROM (SELECT content, arg_min(type, o) AS type, count(DISTINCT scope) AS k FROM n GROUP BY content) GROUP BY type""")
def ingest_nodes(s, d):
    """Facts and entities of all conversations, with how many scopes they have."""
    nodes, _ = ingest.plan(conversation_texts(s, d).where("text is not null"))
    # the first of a content is by seq; a text that is also an entity of an earlier turn counts as a fact here
    first = F.struct((F.col("type") != "text").cast("int").alias("o"), "seq")
    one = nodes.groupBy("content").agg(F.min_by("type", first).alias("type"), F.size(F.array_distinct(F.flatten(F.collect_list("scopes")))).alias("k"))
    return one.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"), F.sum("k").alias("scopes"))


@query(f"SELECT count(*) AS edges FROM (SELECT DISTINCT text, unnest({ENTITIES.format('text')}) AS entity FROM conversations)")
def ingest_edges(s, d):
    _, edges = ingest.plan(conversation_texts(s, d).where("text is not null"), with_causal=False)
    return store.merge_edges(edges).agg(F.count(F.lit(1)).alias("edges"))


@query("""WITH f AS (SELECT DISTINCT p_name AS entity, string_split(p_name,' ') AS w FROM part), k AS (SELECT DISTINCT p_name AS other, string_split(p_name,' ') AS o FROM part UNION SELECT DISTINCT string_split(p_name,' ')[1], [string_split(p_name,' ')[1]] FROM part)
SELECT entity, other FROM f, k WHERE entity<>other AND w[1]=o[1] AND length(entity)>=4 AND length(other)>=4 AND len(w)<=4 AND w[1:least(len(w),len(o))]=o[1:least(len(w),len(o))]""")
def contained_entities(s, d):
    names = t(s, d, "part").select(F.col("p_name").alias("entity")).distinct()
    known = names.select(F.col("entity").alias("content")).unionAll(names.select(F.split_part("entity", F.lit(" "), F.lit(1))))
    return ingest.contained(names, known)


@query()
def ingest_relations(s, d):
    """Relations around connectives; a line of the kind stands before each text, since the tables have few of their own."""
    said = F.concat(F.lit("Work stopped on line "), F.col("doc_id") % 20, F.lit(" because of fault "), F.col("doc_id") % 7, F.lit("; "), F.coalesce("text", F.lit("")))
    return ingest.relations(g_doc(s, d).select(F.col("doc_id").alias("seq"), said.alias("text"), F.array("source").alias("scopes"))).select("seq", "cause", "effect")


ORACLE["ingest_relations"] = "SELECT doc_id AS seq, 'fault '||(doc_id%7) AS cause, 'Work stopped on line '||(doc_id%20) AS effect FROM documents"


@query("""WITH r AS (SELECT 'e'||event_id AS fact, event_type AS cause, 'v'||(event_id%3) AS effect FROM events) SELECT fact, cause||'>'||effect AS causes FROM r""")
def relations_by_fact(s, d):
    ev = t(s, d, "events").select(F.concat(F.lit("e"), "event_id").alias("fact"), F.col("event_type").alias("cause"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("effect"))
    none = F.lit(None).cast("string").alias("label")
    edges = ev.select(F.col("cause").alias("src"), F.col("fact").alias("dst"), none).unionAll(ev.select("effect", "fact", none)).unionAll(ev.select("cause", "effect", F.lit("causes")).distinct())
    said = store.relations_by_fact(edges)
    return said.select("fact", F.concat_ws(";", F.transform("causes", lambda c: F.concat(c["cause"], F.lit(">"), c["effect"]))).alias("causes"))


@query("SELECT DISTINCT 'p'||l_partkey AS content, 'effect' AS role FROM lineitem UNION SELECT DISTINCT 's'||l_suppkey, 'cause' FROM lineitem")
def span_roles(s, d):
    line = t(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("causes").alias("label")).distinct()
    return facts.span_roles(line)


@query(f"""WITH n AS (SELECT 'v'||q.vec_id AS query, 'v'||a.vec_id AS content, {COS} AS score, q.label%2 AS own, a.label%2 AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, 'v'||a.vec_id) AS rank FROM embeddings a, embeddings q WHERE q.vec_id%50=0 AND a.vec_id<>q.vec_id)
SELECT DISTINCT least(query, content) AS a, greatest(query, content) AS b FROM n WHERE rank<=6 AND score>=0.2 AND own<>other""")
def span_ties(s, d):
    v = g_vec(s, d)
    near = search.knn_join(v.where("vec_id % 50 = 0").withColumnRenamed("content", "query"), v, 6)
    return facts.span_ties(near, v.select("content", F.when(F.col("label") % 2 == 0, "cause").otherwise("effect").alias("role")), 0.2)


@query()
def knn_join_approximate(s, d):
    """Nearest by cells; a test measures its recall."""
    v = g_vec(s, d)
    return search.knn_join_approximate(v.where("vec_id % 50 = 0").withColumnRenamed("content", "query"), v, 5)


@query()
def keyword_or_similar(s, d):
    return search.similar_text(named_docs(s, d), "trash licence", 25)


# causal pieces

@query(f"""WITH RECURSIVE {SUP}, r AS (SELECT 's0' AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON e.src=r.node WHERE r.depth<3), f AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
h AS (SELECT DISTINCT f.node AS cause, e.dst AS effect, f.depth+1 AS depth FROM f JOIN e ON e.src=f.node WHERE f.depth<3), l AS (SELECT min((depth, cause, effect)) AS last FROM h WHERE effect='c1')
SELECT cause, effect, depth::INT AS depth FROM h, l WHERE (depth, cause, effect)<=last""")
def causal_chain(s, d):
    """The hops of a walk from s0, in order, up to the first that reaches c1."""
    edges = walk.held(g_sup(s, d))
    return facts.chain_to(walk.hops(edges, walk.reach(edges, start(s), 3), 3), F.col("effect") == "c1")


SUPPORT = "q AS (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst, l_returnflag AS fact FROM lineitem), cut AS (SELECT src, dst FROM q GROUP BY ALL HAVING bool_and(fact='N'))"


def support(s, d) -> DataFrame:
    """One row a line, so that nothing is shuffled before it is asked for."""
    return t(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("fact"))


@query(f"WITH {SUPPORT} SELECT src, dst FROM cut")
def what_if_pruned_edges(s, d):
    """Edges are told apart by their keys, half as long as their names."""
    keys = t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("fact"))
    found = facts.solely_supported(keys, s.createDataFrame([("N",)], "fact string"))
    return found.select(F.concat(F.lit("s"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"))


@query(f"""WITH RECURSIVE {SUP}, {SUPPORT}, k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.src=e.src AND cut.dst=e.dst)),
z AS (SELECT 's0' AS node, 0 AS depth UNION SELECT k.dst, z.depth+1 FROM z JOIN k ON k.src=z.node WHERE z.depth<2) SELECT DISTINCT dst AS span FROM cut WHERE dst IN (SELECT node FROM z)""")
def what_if_survived(s, d):
    """Pruned edges are looked for from a frontier's nodes, and then to what is reached, never all of them."""
    held, gone = support(s, d), s.createDataFrame([("N",)], "fact string")
    left = walk.reach(g_sup(s, d, repeats=True), start(s), 2, blocked=lambda nodes: facts.solely_supported(held, gone, nodes))
    ends = walk.small(left.select(F.col("node").alias("dst")), left.count())
    return facts.survivors(facts.solely_supported(held, gone, ends), left)


@query("""WITH a AS (SELECT 'p'||l_partkey AS src, 'o'||l_orderkey AS nbr, max(l_quantity) AS score FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, nbr) AS rank FROM a WHERE right(nbr,1) IN ('1','2','3')) SELECT src, nbr FROM n WHERE rank<=2""")
def neighbours_in_scope(s, d):
    """The two nearest neighbours of each part among orders in some scopes."""
    line = t(s, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").alias("score"))
    rows = line.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("nbr"), "score")
    held = t(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("content"), F.array(F.substring(F.col("o_orderkey").cast("string"), -1, 1)).alias("scopes"))
    inside = store.in_scopes(store.node_scopes(held), ["1", "2", "3"]).withColumnRenamed("content", "nbr")
    return walk.nearest(rows.join(inside, "nbr", "left_semi"), 2).select("src", "nbr")


# the graph itself

def conversation_graph(s, d):
    """A graph of the longest conversation turns' first lines, with causes stated between them."""
    from factweave.graph import FactGraph

    g = FactGraph(s, back_references=True, dimension=32)
    said = F.concat(F.lit("stage "), F.col("turn"), F.lit(" of run "), F.col("conv_id"), F.lit(" caused stage "), F.col("turn") + 1, F.lit(" of run "), F.col("conv_id"), F.lit("."))
    turns = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), said.alias("text"), F.array(F.concat(F.lit("c"), "conv_id")).alias("scopes"))
    g.add_texts(turns)
    return g


@query()
def graph_ingest(s, d):
    g = conversation_graph(s, d)
    return g.nodes.select("content", "type", F.concat_ws(",", "scopes").alias("scopes"))


@query()
def graph_query(s, d):
    g = conversation_graph(s, d)
    rows = g.query_detailed("stage 0 of run 1", top_k=3, hops=3)
    return s.createDataFrame([(r["content"], r["score"], ",".join(r["scopes"])) for r in rows], "content string, score double, scopes string")


@query()
def graph_discover(s, d):
    g = conversation_graph(s, d)
    rows = g.discover("stage 0 of run 1", top_k=2, hops=3)
    return s.createDataFrame([(r["content"], len(r["path"]), r["cross_session"]) for r in rows], "content string, steps int, cross_session boolean")


@query()
def graph_trace(s, d):
    g = conversation_graph(s, d)
    found = g.trace_effects("stage 0 of run 1 caused stage 1 of run 1.")
    return s.createDataFrame([(h["cause"], h["effect"], h["fact"], h["depth"]) for h in found["chain"]], "cause string, effect string, fact string, depth int")


@query()
def graph_what_if(s, d):
    g = conversation_graph(s, d)
    found = g.what_if("stage 0 of run 1 caused stage 1 of run 1.")
    return s.createDataFrame([(x["span"], x["fact"], x["depth"]) for x in found["collapsed"]], "span string, fact string, depth int")


@query()
def graph_facts(s, d):
    from factweave.service import MemoryService

    return MemoryService(conversation_graph(s, d)).facts("c1").select("content", F.concat_ws(",", "entities").alias("entities"), F.size("causes").alias("n_causes"))

