"""A stored inverted index of words and their trigrams: searches read the lists of their own words only.

A folder holds four Parquet tables, all of them added to batch by batch:

- `postings`: for each word and block of contents the contents that have it, dealt to
  directories by a checksum of the word and sorted by word within files.  A block is some
  contents that a task has read together, so a frequent word has many rows of bounded
  size, and only lists are shuffled, not a row for each word of a content.
- `words`: each word with its number of contents.
- `grams`: for each trigram and block of words the words that have it, dealt and sorted by trigram.
- `stats`: how many contents there are.

A keyword search for k contents reads `words` first.  If a word has k contents or
more, the k-th best score is its weight at least; words whose weights together are
less can't lift a content into the list alone.  Only the other words' lists are read
as a whole, and of these only the blocks in which candidates are.

Contents are unique; adding one again counts it twice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import WORD, padded_trigrams, trigrams, words
from factweave.session import checkpoint, small_batches

#: Directories of a table, contents of a block at most, and values that are pushed down as a list.
BUCKETS, BLOCK, LISTED = 32, 8192, 10_000
#: Words of a block of `grams`; a word has few trigrams.
SPELLED = 65_536
#: Bytes of words after which a block ends too, files of a directory, and contents for each task that writes.
BYTES, FILES, SHARE = 32 << 20, 8, 10_000


#: The columns of the tables; a batch may have written no file at all.
TABLES = {
    "postings": "word string, block int, contents array<string>, n int, batch int, bucket int", "words": "word string, df long, batch int, bucket int",
    "grams": "gram string, block int, words array<string>, n int, batch int, bucket int", "stats": "n long, batch int",
}


def _bucket(x: str) -> int:
    return zlib.crc32(x.encode()) % BUCKETS


def _lists(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """(word, block, contents, n) of blocks of (content, words), with `most` contents at most."""
    block, held, size, rows = TaskContext.get().partitionId() << 15, [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks().sort_by("content")
        own = table["words"].combine_chunks()
        names, row = table["content"].combine_chunks(), pc.list_parent_indices(own)
        words_ = own.flatten().dictionary_encode()
        code = words_.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        count = np.bincount(code, minlength=len(words_.dictionary))
        contents = names.take(row.take(pa.array(order)))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), contents)
        blocks, n = pa.array(np.full(len(count), block & 0x7FFFFFFF), pa.int32()), pa.array(count, pa.int32())
        all_ = pa.RecordBatch.from_arrays([words_.dictionary, blocks, lists, n], ["word", "block", "contents", "n"])
        for low in range(0, len(count), 4096):
            yield all_.slice(low, 4096)

    for batch in batches:
        for low in range(0, batch.num_rows, most):
            part = batch.slice(low, most)
            if held and (rows + part.num_rows > most or size > BYTES):
                yield from out()
                block, held, size, rows = block + 1, [], 0, 0
            held.append(part)
            size, rows = size + part.nbytes, rows + part.num_rows
    if held:
        yield from out()


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_lists of words, which are in lower case, by trigrams."""

    def own() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [list(padded_trigrams(w)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(grams, pa.list_(pa.string()))], ["content", "words"])

    return _lists(own(), SPELLED)


class WordIndex:
    """The index in a folder; `build` makes one, `WordIndex(spark, folder)` opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> WordIndex:
        index = cls(docs.sparkSession, folder)
        index._write(docs, 0)
        return index

    def add(self, docs: DataFrame) -> None:
        """More contents (content, text)."""
        self._write(docs, self._table("stats").agg(F.max("batch")).first()[0] + 1)

    def _write(self, docs: DataFrame, batch: int) -> None:
        docs = docs.where("content is not null")
        n = docs.count()
        small_batches(self.spark)
        held = docs.select(F.col("content").cast("string"), F.coalesce(F.array_distinct(words(F.col("text"))), F.array().cast("array<string>")).alias("words"))
        lists = held.mapInArrow(_lists, "word string, block int, contents array<string>, n int")
        tasks = min(BUCKETS * FILES, max(FILES, -(-n // SHARE)))
        self._append(lists, "postings", batch, tasks, "word", "block")
        # what was written a moment ago, not the texts again
        mine = self._table("postings").where(F.col("batch") == batch)
        self._append(mine.groupBy("word").agg(F.sum("n").alias("df")), "words", batch, tasks, "word")
        grams = self._table("words").where(F.col("batch") == batch).select("word").mapInArrow(_spelled, "word string, block int, contents array<string>, n int")
        self._append(grams.toDF("gram", "block", "words", "n"), "grams", batch, tasks, "gram", "block")
        self.spark.createDataFrame([(n, batch)], "n long, batch int").coalesce(1).write.mode("append").parquet(f"{self.folder}/stats")

    def _append(self, df: DataFrame, name: str, batch: int, tasks: int, key: str, *more: str) -> None:
        bucket = (F.crc32(key) % BUCKETS).cast("int")
        dealt = df.repartition(tasks, bucket, F.pmod(F.xxhash64(key), F.lit(FILES))).withColumns({"batch": F.lit(batch), "bucket": bucket})
        dealt.sortWithinPartitions("bucket", key, *more).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def _rows(self, name: str, key: str, values: list[str]) -> DataFrame:
        """The rows of these keys: other directories aren't listed, other row groups of the files are skipped."""
        return self._table(name).where(F.col("bucket").isin(sorted({_bucket(v) for v in values})) & F.col(key).isin(values))

    def size(self) -> int:
        return self._table("stats").agg(F.sum("n")).first()[0]

    def frequencies(self, query: list[str]) -> dict[str, int]:
        return {r["word"]: r["df"] for r in self._rows("words", "word", query).groupBy("word").agg(F.sum("df").alias("df")).collect()}

    def _hits(self, values: list[str]) -> DataFrame:
        return self._rows("postings", "word", values).select("word", "batch", "block", F.explode("contents").alias("content"))

    def essential(self, weights: dict[str, float], found: dict[str, int], k: int | None) -> list[str]:
        """The words one of which each of the k best has; all without k."""
        order = sorted(weights, key=lambda w: (-weights[w], w))
        if k is None:
            return order
        least = max((weights[w] for w in order if found[w] >= k), default=0.0)
        while order and sum(weights[w] for w in weights if w not in order[:-1]) < least - 1e-6:
            order.pop()
        return order

    def keyword(self, query: list[str], k: int | None) -> DataFrame:
        """(content, score), all without k: sum of ln(1 + N/df) over the query's words that a content has."""
        query = list(dict.fromkeys(query))
        found, n = self.frequencies(query), self.size()
        weights = {w: math.log(1 + n / found[w]) for w in query if w in found}
        if not weights:
            return self.spark.createDataFrame([], "content string, score double")
        must = self.essential(weights, found, k)
        hits, rest = self._hits(must), [w for w in weights if w not in must]
        if rest:
            hits = checkpoint(hits)
            blocks = [tuple(r) for r in hits.select("batch", "block").distinct().limit(LISTED + 1).collect()]
            more = self._hits(rest)
            if len(blocks) <= LISTED:
                more = more.where(F.col("block").isin(sorted({b for _, b in blocks})) & F.col("batch").isin(sorted({b for b, _ in blocks})))
            hits = hits.unionByName(more.join(hits.select("content").distinct(), "content", "left_semi"))
        weight = F.element_at(F.create_map(*(F.lit(x) for w in weights.items() for x in w)), F.col("word"))
        scored = hits.groupBy("content").agg(F.round(F.sum(weight), 6).alias("score"))
        return scored if k is None else scored.orderBy(F.desc("score"), "content").limit(k)

    def spellings(self, query: list[str], least: float = 0.45) -> DataFrame:
        """(word, q): the indexed words that share so many trigrams with a word of the query."""
        own = {q: padded_trigrams(q.lower()) for q in query}
        asked = self.spark.createDataFrame([(q, len(t), g) for q, t in own.items() for g in sorted(t)], "q string, m int, gram string")
        grams = self._rows("grams", "gram", sorted(set().union(*own.values()))).select("gram", F.explode("words").alias("word")).distinct()
        shared = grams.join(F.broadcast(asked), "gram").groupBy("word", "q", "m").agg(F.count(F.lit(1)).alias("both"))
        # a word has what is shared at least, so few are left to be counted
        few = shared.where(F.col("both") >= least * F.col("m") - 1e-6).withColumn("n", F.size(trigrams(F.col("word"))))
        return few.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= least).select("word", "q")

    def _of(self, spelled: DataFrame) -> DataFrame:
        """spelled (word, ...) with the contents of each word."""
        spelled = checkpoint(spelled)
        listed = [r["word"] for r in spelled.select("word").distinct().limit(LISTED + 1).collect()]
        lists = self._table("postings") if len(listed) > LISTED else self._rows("postings", "word", listed)
        return lists.select("word", F.explode("contents").alias("content")).join(spelled, "word")

    def fuzzy(self, query: list[str], k: int | None, least: float = 0.45) -> DataFrame:
        """Like keyword, but a content has a query word if any of its words is spelled nearly like it."""
        query = list(dict.fromkeys(query))
        if not query:
            return self.spark.createDataFrame([], "content string, score double")
        hits = checkpoint(self._of(self.spellings(query, least)).select("content", "q").distinct())
        # as many rows as query words
        weights = hits.groupBy("q").agg(F.log(1 + F.lit(self.size()) / F.count(F.lit(1))).alias("weight"))
        scored = hits.join(F.broadcast(weights), "q").groupBy("content").agg(F.round(F.sum("weight"), 6).alias("score"))
        return scored if k is None else scored.orderBy(F.desc("score"), "content").limit(k)

    def phrase(self, docs: DataFrame, query: str, k: int | None = None) -> DataFrame:
        """(content, score, rank) of docs (content, text) that contain the query as it is, in any case, best keyword score first.

        Words inside the phrase must be a content's own, the first may be the end of one and the last the beginning; texts
        are looked at only where all of them occur.
        """
        pieces = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(f"({WORD}+)"), 1)
        edge = lambda p: F.lit(query).rlike(p)
        own, opens, closes = self.spark.range(1).select(pieces, edge(f"^{WORD}"), edge(f"{WORD}$")).first()
        vocabulary, parts = self._table("words").select("word").distinct(), []
        for i, piece in enumerate(own):
            if len(piece) < 2:
                continue  # not indexed
            left, right = opens and i == 0, closes and i == len(own) - 1
            if not left and not right:
                some = self._rows("words", "word", [piece]).select("word").distinct()
            else:
                test = F.contains if left and right else F.endswith if left else F.startswith
                some = vocabulary.where(test(F.col("word"), F.lit(piece)))
            parts.append(some.withColumn("part", F.lit(i)))
        if parts:
            spelled = parts[0]
            for more in parts[1:]:
                spelled = spelled.unionByName(more)
            all_ = self._of(spelled).groupBy("content").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts))
            docs = docs.join(all_.select("content"), "content", "left_semi")
        found = docs.where(F.contains(F.lower("text"), F.lower(F.lit(query)))).select("content")
        scored = found.join(self.keyword([p for p in own if len(p) > 1], None), "content", "left").select("content", F.coalesce("score", F.lit(0.0)).alias("score"))
        if k is None:
            return scored
        return scored.orderBy(F.desc("score"), "content").limit(k)
