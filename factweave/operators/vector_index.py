"""A stored index for nearest neighbours: inverted lists of product-quantised residuals, exact re-ranking.

A folder holds `model` (centres of the lists, code books, lists to probe; fitted
once on a bounded sample) and `nodes`, a Parquet table with a row a node, sorted by
list: its list, a number, its code of one byte a dimension (or for each `width` of them),
content and embedding.  Batches are added to the table without a new fit.

A search first reads lists, numbers and codes alone: packs of queries are multiplied
with the vectors that packs of codes stand for, and the best `factor` times k of all
tasks are a query's short list, with those that the codes' error alone puts behind the
k-th, as in a group of near copies (up to MOST times as many).  Only these are compared
exactly.  Queries meet lists by an equi-join of packs with packs, so neither side is
broadcast; a list that holds much of the table is dealt to several tasks, each with
the list's queries.

How many lists a query probes is measured at the fit: so many that `recall` of the
sample's true neighbours are in them.  Where that is more than half of the lists, as on
vectors without clusters, all are one list, and the codes do the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.session import checkpoint, small_batches

#: Rows of nodes that are compared at once, queries that share a pack, and rows of a list for each task that it is dealt to.
NODES, QUERIES, PART = 4096, 256, 65_536
#: A list's rows are written by so many tasks.
SALTS = 8
#: Short lists are at most so many times longer for near copies, and entries that a task holds before it hands them on.
MOST, HELD = 16, 2_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _means(x: np.ndarray, k: int, rounds: int, cosine: bool) -> np.ndarray:
    """k centres of x by Lloyd's rounds, begun at rows spread over it."""
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centre))
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        if cosine:
            centre = _unit(centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of each row the nearest centre."""
    if x.shape[1] == 1:
        order = np.argsort(centre[:, 0], kind="stable")
        held = centre[order, 0]
        return order[np.searchsorted((held[1:] + held[:-1]) / 2, x[:, 0])]
    out, half = np.empty(len(x), np.int64), (centre**2).sum(1) / 2
    for low in range(0, len(x), 4096):
        out[low : low + 4096] = (x[low : low + 4096] @ centre.T - half).argmax(1)
    return out


class Model:
    """Centres (lists x dimensions), books (parts x 256 x dimensions of a part), how many lists a query probes, the products' usual error."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, probe: int, error: float = 0.0):
        self.centres, self.books, self.probe, self.error = centres, books, probe, error

    @classmethod
    def fitted(cls, x: np.ndarray, lists: int, width: int, recall: float, k: int) -> Model:
        x = _unit(x)
        centres = _means(x, lists, 10, True)
        own = (x @ centres.T).argmax(1)
        rest = cls._parts(x - centres[own], width)
        books = np.stack([_means(np.ascontiguousarray(part), 256, 8, False) for part in rest])
        asked = x[np.linspace(0, len(x) - 1, min(500, len(x))).astype(int)]
        near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
        # the turn at which each true neighbour's list is probed
        turn = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], own[near]]
        probe = int(np.quantile(turn, recall, method="higher")) + 1 if turn.size else 1
        model = cls(centres, books, probe if probe <= len(centres) / 2 else len(centres))
        model.error = float(np.sqrt(((model.decoded(*model.coded(x)) - x) ** 2).sum(1).mean() / x.shape[1]))
        return model

    @staticmethod
    def _parts(x: np.ndarray, width: int) -> np.ndarray:
        """x cut into parts of so many dimensions; the last one is filled up with zeros."""
        n = -(-x.shape[1] // width)
        return np.pad(x, ((0, 0), (0, n * width - x.shape[1]))).reshape(len(x), n, width).transpose(1, 0, 2)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code (bytes) of each vector."""
        x = _unit(x)
        own = (x @ self.centres.T).argmax(1)
        rest = self._parts(x - self.centres[own], self.books.shape[2])
        return own, np.stack([_nearest(part, book) for part, book in zip(rest, self.books)], axis=1).astype(np.uint8)

    def lists(self, x: np.ndarray, probe: int) -> np.ndarray:
        return np.argsort(-(_unit(x) @ self.centres.T), axis=1, kind="stable")[:, :probe]

    def products(self, x: np.ndarray) -> np.ndarray:
        """Of each query the product of its parts with all code words (queries, parts, 256)."""
        return np.einsum("pqd,pwd->qpw", self._parts(_unit(x), self.books.shape[2]), self.books)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        parts = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return self.centres[own] + parts[:, : self.centres.shape[1]]


class VectorIndex:
    """The index in a folder; `fit` makes one, `VectorIndex(spark, folder)` opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        row = spark.read.parquet(f"{folder}/model").first()
        shape = [tuple(s) for s in row["shapes"]]
        centres, books = (np.frombuffer(bytes(row[c]), "<f8").reshape(s) for c, s in zip(("centres", "books"), shape))
        self.model = Model(centres, books, row["probe"], row["error"])

    @classmethod
    def fit(cls, nodes: DataFrame, folder: str, lists: int | None = None, width: int = 1, sample: int = 20_000, recall: float = 0.995, k: int = 10) -> VectorIndex:
        """An index of nodes (content, embedding).  The model comes from the `sample` nodes with the smallest hash of content."""
        spark = nodes.sparkSession
        rows = nodes.where("embedding is not null").select("embedding").orderBy(F.xxhash64("content"), "content").limit(sample).collect()
        x = np.array([r["embedding"] for r in rows], float) if rows else np.zeros((1, 1))
        n = lists or max(1, min(int(np.sqrt(nodes.count())), len(x) // 20))
        model = Model.fitted(x, n, width, recall, k)
        kept = [(model.centres.astype("<f8").tobytes(), model.books.astype("<f8").tobytes(), [list(model.centres.shape), list(model.books.shape)], model.probe, model.error)]
        spark.createDataFrame(kept, "centres binary, books binary, shapes array<array<int>>, probe int, error double").coalesce(1).write.parquet(f"{folder}/model")
        index = cls(spark, folder)
        index.add(nodes)
        return index

    def add(self, nodes: DataFrame) -> None:
        """Writes more nodes (content, embedding) with the model as it is; those without an embedding aren't indexed."""
        model = self.model

        def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    own, codes = model.coded(np.stack(f.embedding.to_numpy()).astype(float))
                    yield pd.DataFrame({"list": own.astype(np.int32), "code": [c.tobytes() for c in codes], "content": f.content, "embedding": f.embedding})

        coded = nodes.where("embedding is not null").select("content", "embedding").mapInPandas(code, "list int, code binary, content string, embedding array<float>")
        sorted_ = coded.repartition("list", F.pmod(F.xxhash64("content"), F.lit(SALTS))).sortWithinPartitions("list", "content")
        sorted_.withColumn("number", F.monotonically_increasing_id()).withColumn("batch", F.lit(self._batches())).write.mode("append").parquet(f"{self.folder}/nodes")

    def _batches(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/nodes")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return (self.nodes().agg(F.max("batch")).first()[0] or 0) + 1

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes")

    def shortlist(self, queries: DataFrame, most: int, probe: int | None = None, k: int | None = None) -> DataFrame:
        """(query, batch, number): of queries (query, embedding) the nodes with the best products by their codes.

        These are `most`, and with k those too whose product is behind the k-th by less than four times its usual error.
        """
        model, probe = self.model, probe or self.model.probe
        small_batches(self.spark)
        everywhere, margin = probe >= len(model.centres), 4 * model.error if k else 0.0
        key = F.lit(0) if everywhere else F.col("list")
        sizes = {r["list"]: r["n"] for r in self.nodes().groupBy(key.alias("list")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        tasks = self.spark.sparkContext.defaultParallelism if everywhere else 1
        parts = {x: max(-(-n // PART), min(tasks, -(-n // NODES))) for x, n in sizes.items()}

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = np.stack(f.embedding.to_numpy()).astype(float)
                    lists = [[0]] * len(x) if everywhere else model.lists(x, probe).astype(np.int32)
                    asked = pd.DataFrame({"list": list(lists), "query": f["query"].to_numpy(), "vector": [v.tobytes() for v in _unit(x).astype("<f4")]}).explode("list")
                    asked["salt"] = [range(parts.get(x, 0)) for x in asked["list"]]
                    yield asked.explode("salt").dropna(subset="salt").astype({"list": np.int32, "salt": np.int32})

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Packs of neighbouring rows of one list."""
            turn = TaskContext.get().partitionId()
            for batch in batches:
                own = batch.column("list").to_numpy()
                keys = np.zeros_like(own) if everywhere else own
                cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(own) else []
                for begin, end in zip(cut, cut[1:] + [len(own)]):
                    for low in range(begin, end, NODES):
                        high, turn = min(low + NODES, end), turn + 1
                        numbers = np.stack([batch.column(c).to_numpy()[low:high].astype(np.int64) for c in ("batch", "number", "list")])
                        codes = b"".join(batch.column("code").slice(low, high - low).to_pylist())
                        x = int(keys[low])
                        yield pa.RecordBatch.from_pydict({"list": pa.array([x], pa.int32()), "salt": pa.array([turn % parts[x]], pa.int32()), "numbers": pa.array([numbers.tobytes()], pa.binary()), "codes": pa.array([codes], pa.binary())})

        asked = queries.select("query", "embedding").mapInPandas(near, "list int, query string, vector binary, salt int")
        pack = F.pmod(F.xxhash64("query"), F.ceil(F.col("n") / QUERIES)).alias("pack")
        counts = asked.groupBy("list", "salt").agg(F.count(F.lit(1)).alias("n"))
        packs = asked.join(counts, ["list", "salt"]).select("list", "salt", "query", "vector", pack).groupBy("list", "salt", "pack").agg(F.collect_list(F.struct("query", "vector")).alias("asked"))
        lists = self.nodes().select("list", "batch", "number", "code").mapInArrow(held, "list int, salt int, numbers binary, codes binary")
        met = lists.join(packs, ["list", "salt"]).select("numbers", "codes", "asked")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                for query, (own, of) in found.items():
                    yield pa.RecordBatch.from_pydict({"query": pa.array([query] * len(own), pa.string()), "batch": of[0], "number": of[1], "near": own})

            for batch in batches:
                for i in range(batch.num_rows):
                    numbers = np.frombuffer(batch.column("numbers")[i].as_py(), np.int64).reshape(3, -1)
                    codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(numbers.shape[1], -1)
                    asked = batch.column("asked")[i].values
                    names = asked.field("query").to_pylist()
                    x = np.frombuffer(b"".join(asked.field("vector").to_pylist()), "<f4").reshape(len(names), -1)
                    score = x.astype(float) @ model.decoded(numbers[2], codes).T
                    for name, own in zip(names, score):
                        old, of = found.get(name), numbers[:2]
                        if old is not None:
                            size -= len(old[0])
                            own, of = np.append(old[0], own), np.append(old[1], of, 1)
                        top = np.arange(len(own))
                        if len(own) > most:
                            top = np.argpartition(-own, most - 1)[:most]
                            if k:
                                behind = np.flatnonzero(own >= np.partition(own[top], most - k)[most - k] - margin)
                                if len(behind) > MOST * most:
                                    behind = behind[np.argpartition(-own[behind], MOST * most - 1)[: MOST * most]]
                                top = np.union1d(top, behind)
                        found[name] = own[top], of[:, top]
                        size += len(top)
                    if size > HELD:
                        yield from out()
                        found, size = {}, 0
            yield from out()

        w = Window.partitionBy("query")
        order = F.desc("near"), F.col("batch"), F.col("number")
        ranked = met.mapInArrow(best, "query string, batch long, number long, near double").withColumn("place", F.row_number().over(w.orderBy(*order)))
        good = F.col("place") <= most
        if k:
            ranked = ranked.where(F.col("place") <= MOST * most).withColumn("least", F.min(F.when(F.col("place") <= k, F.col("near"))).over(w))
            good = good | (F.col("near") >= F.col("least") - margin)
        return ranked.where(good).select("query", F.col("batch").cast("int").alias("batch"), "number")

    def search(self, queries: DataFrame, k: int, factor: int = 8, probe: int | None = None) -> DataFrame:
        """(query, content, score, rank): for each query (query, embedding) its k nearest nodes other than itself, of those on its short list."""
        queries = checkpoint(queries.where("embedding is not null").select("query", F.col("embedding").cast("array<float>").alias("embedding")))
        # one more, since a query may be on its own list
        short = checkpoint(self.shortlist(queries, factor * k + 1, probe, k + 1))
        found = self.nodes().select("batch", "number", "content", "embedding").join(short, ["batch", "number"]).where("content <> query")
        found = found.join(queries.select("query", F.col("embedding").alias("asked")), "query")

        @F.pandas_udf("double")
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype=float)
            x, y = (_unit(np.stack(v.to_numpy()).astype(float)) for v in (a, b))
            return pd.Series(np.rint((x * y).sum(1) * 1e6) / 1e6)

        w = Window.partitionBy("query").orderBy(F.desc("score"), "content")
        scored = found.select("query", "content", score("embedding", "asked").alias("score"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
