"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import anchors, ctw, lpf, ngrams, pii, quality, raking, ranked, setsketch, tagpaths, toxicity, turns, winnow
from factweave.llm import exchange as X


#: The key of the registered queries and of the pipeline where the session has none in spark.factweave.secret.  Anyone can
#: read it here, so it protects nothing; production sets its own.
TEST_SECRET = "open sesame"
#: Shares by language that the queries mix to; those by source and topic are flattened.
TARGETS = {"lang": {"en": 0.55, "de": 0.18, "fr": 0.15, "es": 0.12}}


def secret(spark: SparkSession) -> str:
    return spark.conf.get("spark.factweave.secret", None) or TEST_SECRET


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    X.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"))


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, _read(spark, sf_dir, "labels"), folds=5, held=0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(_read(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark), spans="spans")
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_found"), "spans")


def op6_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.remove_repeats(_read(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raking.mixed(_read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), TARGETS, keep_text=False)
    return found.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_sampled").alias("sampled"))


def op8_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lpf.remove_repeated_bytes(_read(spark, sf_dir, "documents"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op11_multiple_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similar(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op12_windowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op13_min_plus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    found = turns.repair(turns.damaged(rows), rows)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_context_tree_weighting, op2_tag_path_ratios, op3_counterfactual_toxicity, op4_adaptive_quality, op5_feistel_pseudonyms, op6_fixed_block_anchors, op7_raked_mixture, op8_setsketch_near_duplicates, op9_longest_previous_factor, op10_winnowing, op11_multiple_order_join, op12_windowed_search, op13_min_plus_repair, pipeline)}

#: For what SQL says without too much work; tests hold the others against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_fixed_block_anchors": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w)-18, 1))) AS i FROM d),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i+19], ' ') ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i+20)) AS i FROM n WHERE k>1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS i FROM d),
y AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id=x.doc_id AND g.i=x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed,0)::BIGINT AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
    "op10_winnowing": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1],' ') AS g FROM (SELECT item_id, w, least(len(w),10) AS k, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM b WHERE len(w)>0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1],' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON bw.k=dw.k AND bw.g=dw.g),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_multiple_order_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1, len(w)-2), lambda i: array_to_string(w[i:i+3],' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g=b.g AND a.doc_id<b.doc_id AND 100*least(a.n,b.n)>=85*greatest(a.n,b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*)>=85*(a.n+b.n-count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a=r.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.a=s.doc_id GROUP BY s.doc_id, g""",
    "op12_windowed_search": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w)>0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000*ln((2*n_docs+2)::DOUBLE/(2*count(*)+1)))::BIGINT AS weight FROM t, s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times*weight*((1000000000*tf)//(1000*tf+8*(100-75+((75*n*n_docs)//n_terms)))))::BIGINT AS score FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, k::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM r WHERE score>0) WHERE k<=10""",
}
