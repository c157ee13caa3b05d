"""Searches: exact nearest neighbours, keyword scores, rank fusion, recency blend."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import jaccard, padded_trigrams, trigrams, words
from factweave.functions.vector import cosine
from factweave.session import checkpoint, removed, shared_folder, small_batches


def knn(nodes: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nodes (content, embedding) nearest to one query vector; a top-k, no shuffle of the table."""
    df = nodes if where is None else nodes.where(where)
    score = cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)))
    return df.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "content").limit(k).select("content", "score")


def scored(nodes: DataFrame, query: list[float]) -> DataFrame:
    """(content, score) of all nodes."""
    return nodes.select("content", F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 6).alias("score"))


#: Queries of a block that a task compares at once.
ROWS = 256


def knn_join(queries: DataFrame, nodes: DataFrame, k: int, block: int = 4096, by: str | None = None) -> DataFrame:
    """(query, content, score, rank): for each query (query, embedding) its k nearest nodes other than itself.

    Queries and nodes are dealt into blocks; a task multiplies two blocks and keeps k per query, so pairs never become
    rows, and the last step ranks k rows a query and block.  With by, only blocks with the same value meet.
    """
    small_batches(nodes.sparkSession)
    key = [by] if by else []

    def blocks(df: DataFrame, name: str, short: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for value, part in f.groupby(by, sort=False) if by else [(None, f)]:
                    for low in range(0, len(part), block):
                        x = part.iloc[low : low + block]
                        row = {f"{short}_keys": [list(x[name])], f"{short}_data": [np.stack(x.embedding.to_numpy()).astype("<f8").tobytes()]}
                        yield pd.DataFrame({by: [value]} | row if by else row)

        kind = f"{by} {dict(df.dtypes)[by]}, " if by else ""
        return df.select(*key, name, "embedding").mapInPandas(run, f"{kind}{short}_keys array<string>, {short}_data binary")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f.itertuples():
                a, b = (np.frombuffer(d, "<f8").reshape(len(n), -1) for d, n in ((x.q_data, x.q_keys), (x.n_data, x.n_keys)))
                unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
                names = np.array(x.n_keys, object)
                order = np.argsort(names.astype(str), kind="stable")
                names, b = names[order], b[order]
                place = {name: i for i, name in enumerate(names)}
                b = unit(b).T
                for low in range(0, len(a), ROWS):
                    asked = np.array(x.q_keys[low : low + ROWS], object)
                    # millionths first, then the name: one number to sort by
                    worth = np.rint((unit(a[low : low + ROWS]) @ b) * 1e6).astype(np.int64)
                    rank = -worth * (len(names) + 1) + np.arange(len(names))
                    for i, q in enumerate(asked):
                        if q in place:
                            rank[i, place[q]] = np.iinfo(np.int64).max
                    top = np.argsort(rank, axis=1)[:, :k] if len(names) <= 4 * k else np.argpartition(rank, k - 1, axis=1)[:, :k]
                    row = np.repeat(np.arange(len(asked)), top.shape[1])
                    col = top.ravel()
                    good = rank[row, col] < np.iinfo(np.int64).max
                    yield pd.DataFrame({"query": asked[row[good]], "content": names[col[good]], "score": worth[row[good], col[good]] / 1e6})

    left, right = blocks(queries, "query", "q"), blocks(nodes, "content", "n")
    pairs = left.join(right, by) if by else left.crossJoin(right)
    found = pairs.drop(*key).mapInPandas(best, "query string, content string, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "content")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join_approximate(queries: DataFrame, nodes: DataFrame, k: int, cells: int | None = None, probe: int | None = None, factor: int = 8) -> DataFrame:
    """knn_join by a vector index made for it in the shared folder: `factor` times k nodes a query are compared exactly.

    With cells and probe, the index has so many lists and a query looks into so many; both are measured on a sample without.
    """
    from factweave.operators.vector_index import VectorIndex

    spark = nodes.sparkSession
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4()}"
    try:
        return checkpoint(VectorIndex.fit(nodes, folder, cells, k=k).search(queries, k, factor, probe))
    finally:
        removed(spark, folder)


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its rows' ranks in a total order, without a task that has them all.

    Ranges of the order are sorted apart; only their sizes reach the driver.
    """
    df = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = {r["part"]: r["n"] for r in df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))])
    offset = F.element_at(F.array(*(F.lit(int(x)) for x in before)), part.cast("int") + 1)
    return df.withColumn(name, (offset + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int"))


def keyword(docs: DataFrame, query: list[str], k: int | None) -> DataFrame:
    """(content, score), all without k: sum of ln(1 + N/df) over the query's words that a document (content, text) has."""
    # texts are looked at once; what is kept of them has few words
    held = checkpoint(docs.select("content", F.array_intersect(words(F.col("text")), F.array(*map(F.lit, query))).alias("hit")))
    n = held.agg(*(F.sum(F.array_contains("hit", w).cast("long")).alias(f"df{i}") for i, w in enumerate(query)), F.count(F.lit(1)).alias("n"))
    score = sum((F.when(F.array_contains("hit", w), F.log(1 + F.col("n") / F.col(f"df{i}"))).otherwise(0.0) for i, w in enumerate(query)), F.lit(0.0))
    found = held.crossJoin(F.broadcast(n)).where(F.size("hit") > 0)
    found = found.select("content", F.round(score, 6).alias("score"))
    return found if k is None else found.orderBy(F.desc("score"), "content").limit(k)


def fuse(a: DataFrame, b: DataFrame, k: int = 60, window: int | None = None, nearest: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (content, score).

    A missing rank adds nothing.  With window, both lists end there and a missing rank counts as window + 1; with nearest,
    only the first so many of a are candidates.
    """

    def places(df: DataFrame, name: str, most: int | None) -> DataFrame:
        order = F.desc("score"), F.col("content")
        if most is None:
            return ranked(df.select("content", "score"), name, *order).select("content", name)
        # a top-k, and a window over its rows alone
        return df.orderBy(*order).limit(most).select("content", F.row_number().over(Window.orderBy(*order)).alias(name))

    x, y = places(a, "ra", min((m for m in (window, nearest) if m is not None), default=None)), places(b, "rb", window)
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0 if window is None else 1.0 / (k + window + 1)))
    both = x.join(y, "content", "full_outer" if nearest is None else "left")
    return both.select("content", F.round(part("ra") + part("rb"), 9).alias("score"))


def blend(hits: DataFrame, weight: float) -> DataFrame:
    """(1 - w) min-max score + w min-max time of hits (content, score, ts); flat values count 0.5, unknown times 0."""
    ends = hits.agg(F.min("score").alias("s0"), F.max("score").alias("s1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    df = hits.crossJoin(F.broadcast(ends))
    scaled = lambda x, a, b: F.when(F.col(x).isNull(), 0.0).when(F.col(a) == F.col(b), 0.5).otherwise((F.col(x) - F.col(a)) / (F.col(b) - F.col(a)))
    return df.select("content", F.round((1 - weight) * scaled("score", "s0", "s1") + weight * scaled("ts", "t0", "t1"), 6).alias("score"))


def _near_words(query: list[str], least: float):
    """For mapInArrow: of (content, words) the (content, q) where a word is spelled nearly like q."""
    own = {q: padded_trigrams(q.lower()) for q in query}
    having = {g: [q for q in query if g in own[q]] for g in set().union(*own.values())}
    fewest = min(least * len(t) for t in own.values()) - 1e-6
    # a word without any of these has no trigram of the query
    some = "|".join(sorted(("^" if g[0] == " " else "") + re.escape(g.strip()) + ("$" if g[-1] == " " else "") for g in having))

    def near(word: str) -> list[str]:
        t = padded_trigrams(word)
        shared = t & having.keys()
        if len(shared) < fewest:
            return []
        both = Counter(q for g in shared for q in having[g])
        return [q for q, n in both.items() if n / (len(t) + len(own[q]) - n) >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, content = batch.column("words"), batch.column("content")
            held = lists.flatten()
            at = pc.indices_nonzero(pc.match_substring_regex(held, some))
            row, coded = pc.list_parent_indices(lists).take(at).to_numpy(), held.take(at).dictionary_encode()
            places: dict[str, list[int]] = {}
            for i, word in enumerate(coded.dictionary.to_pylist()):
                for q in near(word):
                    places.setdefault(q, []).append(i)
            code = coded.indices.to_numpy()
            for q, own_ in places.items():
                rows = np.unique(row[np.isin(code, own_)])
                yield pa.RecordBatch.from_arrays([content.take(pa.array(rows)), pa.array([q] * len(rows), pa.string())], ["content", "q"])

    return run


def fuzzy_keyword(docs: DataFrame, query: list[str], k: int | None, least: float = 0.45) -> DataFrame:
    """Like keyword, but a document has a query word if any of its words shares so many trigrams with it; all hits without k."""
    if not query:
        return docs.sparkSession.createDataFrame([], "content string, score double")
    small_batches(docs.sparkSession)
    # texts are looked at once; only query words, not a text's own, are shuffled
    held = docs.where(F.col("text").isNotNull()).select("content", F.array_distinct(words(F.col("text"))).alias("words"))
    kind = docs.schema["content"].dataType.simpleString()
    hits = checkpoint(held.mapInArrow(_near_words(list(dict.fromkeys(query)), least), f"content {kind}, q string").distinct())
    weights = hits.groupBy("q").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))
    # as many rows as query words
    scored = hits.join(F.broadcast(weights), "q").groupBy("content").agg(F.round(F.sum(F.log(1 + F.col("n") / F.col("df"))), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "content").limit(k)


def similar_text(docs: DataFrame, query: str, k: int, least: float = 0.45) -> DataFrame:
    """(content, score): facts by fuzzy keyword, and by trigrams of whole texts where no word of the query is in any."""
    words_ = [w for w in docs.sparkSession.range(1).select(words(F.lit(query)).alias("w")).first()["w"]]
    found = fuzzy_keyword(docs, list(dict.fromkeys(words_)), k, least)
    if not found.isEmpty():
        return found
    score = F.round(jaccard(trigrams(F.col("text")), trigrams(F.lit(query))), 6)
    return docs.select("content", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "content").limit(k)


def fill(first: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """k contents: those of first (content, seq), then those of more, each once and in their order."""
    both = first.select("content", F.lit(0).alias("part"), "seq").unionByName(more.select("content", F.lit(1).alias("part"), "seq"))
    one = both.groupBy("content").agg(F.min(F.struct("part", "seq")).alias("at"))
    return one.select("content", "at.part", "at.seq").orderBy("part", "seq", "content").limit(k)


def phrase(docs: DataFrame, query: str) -> DataFrame:
    """Documents that contain the query as it is, in any case."""
    return docs.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("content")
