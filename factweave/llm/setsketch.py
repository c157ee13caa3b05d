"""Near-duplicate detection by SetSketch registers.

A document is the set of its shingles.  Register i of its sketch is
floor(1 - log_b x), where x is the least of its elements' exponential values for
i; an element's values come as one Poisson process whose points choose registers
at random, so most elements stop after a few points.  Registers are merged by
their maximum, and equal in two sets with about their Jaccard similarity.

Bands of registers give candidates; texts with equal sets are one class from
the start.  A class is compared with a few leaders of its buckets.  From the
registers and the two sizes the likeliest similarity is computed, which discards
pairs far below the threshold; the rest is confirmed on the full sets.  What a
bucket still holds in more than one component is compared across components on
the full sets, in blocks and without making pairs, so no link between them is
lost.  Components come from alternating large-star and
small-star steps; each state is checkpointed in the shared folder.

With the defaults, a pair at the threshold shares no band once in 300 000 times.

Nulls and texts without words have empty sets and are linked with nothing; a
text with fewer words than a shingle is one shingle.  Rows with equal or null ids
are treated one by one: a null id links like any other, and is the least id of a
group only if it has no other.  Ids may be of any type that has an order.  An empty table gives an empty one.  Texts are in
memory a few megabytes at a time, a longer one as a whole.  Other columns are
ignored, or kept by distinct().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import exchange as X
from factweave.llm.textops import SPACED, U, hashed_words, mix, mix1, pieces, prefix_sums, spans, unique_per_text, windows

#: A register is a byte: 1.06**-255 / 5 is far below the least value of sets of a million.
BASE, RATE = 1.06, 5.0
BANDS, WIDTH = 42, 6
REGISTERS = BANDS * WIDTH


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text's begin."""
    hashes, first = hashed_words(column, SPACED, True)
    runs, at = windows(hashes, first, k)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < k))
    runs = np.concatenate((runs, spans(prefix_sums(hashes), first[few], first[few + 1])))
    text = np.concatenate((np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0)), few))
    order = np.argsort(text, kind="stable")
    return unique_per_text(runs[order], np.searchsorted(text[order], np.arange(len(count) + 1)))


def registers(held: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The sketch of each set."""
    n = len(first) - 1
    least = np.full(n * m, np.inf)
    text = np.repeat(np.arange(n), np.diff(first))
    x = np.zeros(len(held))
    turn = 0
    while len(held):
        turn += 1
        u = mix(held + U(mix1(turn)))
        x = x - np.log(((u >> U(32)).astype(float) + 0.5) / 2.0**32) / (m * RATE)
        np.minimum.at(least, text * m + (((u & U(0xFFFFFFFF)) * U(m)) >> U(32)).astype(np.int64), x)
        if turn < 8 or turn % 8 == 0:
            own = np.unique(text) if turn > 8 else np.arange(n)
            worst = np.zeros(n)
            worst[own] = least.reshape(n, m)[own].max(1)
            more = x < worst[text]
            held, text, x = held[more], text[more], x[more]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 255).astype(np.uint8).reshape(n, m)


def likeliest(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The similarity that makes pairs of registers, given the sets' sizes, likeliest."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    j = np.minimum(u / (1 - u), (1 - u) / u) * np.linspace(0, 1, 101)
    p = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    up, down = p(u - (1 - u) * j), p(1 - u - u * j)
    fit = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def _class(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    size = np.diff(first)
    out = spans(prefix_sums(held), first[:-1], first[1:])
    return np.where(size > 0, np.where(out == 0, U(1), out), U(0)).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row of docs: doc_id, digest (of its text), node (the class of its set), n_shingles, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                held, first = shingle_sets(piece.column(1), k)
                regs = registers(held, first)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(_class(held, first)), pa.array(np.diff(first)), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "digest", "node", "n_shingles", "registers"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("digest long, node long, n_shingles long, registers binary").fields])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, digest); by id and text, since ids may be null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                held, first = shingle_sets(piece.column(0), k)
                node = _class(held, first)
                mine = np.flatnonzero(node == piece.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array([held[first[i] : first[i + 1]].tobytes() for i in mine], pa.binary())], ["node", "shingles"])

    own = wanted.select("node", F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"))
    found = docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_digest")))
    return found.select("text", "node").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity, and whose registers allow so much."""
    a = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("size_a"), F.col("registers").alias("regs_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("size_b"), F.col("registers").alias("regs_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                x = batch.slice(low, 512)
                regs = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("regs_a", "regs_b")]
                good = likeliest(*regs, *(x.column(c).to_numpy().astype(float) for c in ("size_a", "size_b"))) >= least
                yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(good)), x.column("b").filter(pa.array(good))], ["a", "b"])

    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    return near.select("a", "b", "size_a", "size_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(sums: DataFrame, key: str) -> DataFrame:
    """sums by key, dealt out again before they are joined.

    An aggregate that is joined where it was made keeps Spark from splitting the partition of a hub; the sum with 0 hides
    from it that the rows are there already.  There is a row a key, and with it AQE can split the other side.
    """
    return sums.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b): the least node that each reaches."""
    links = X.checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
        least = _apart(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = _apart(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").distinct()
        links = X.checkpoint(small.select(F.col("x").alias("a"), F.col("y").alias("b")))
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now


#: Sets of a zone that are compared with as many others in one task.
BLOCK = 256


def _across(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of held (node, low, component), whose buckets have the leader low.

    Nodes that buckets connect are a zone.  All that isn't of its largest component is compared with the whole zone, in
    blocks of sets; for a set and a component one link is enough.
    """
    zones = components(held.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "zone")
    members = held.select("node", "component").distinct().join(zones, "node")
    count = members.groupBy("zone", "component").agg(F.count(F.lit(1)).alias("n"))
    count = count.groupBy("zone").agg(F.sum("n").alias("n_all"), F.max("n").alias("n_main"), F.max_by("component", F.struct("n", "component")).alias("main"))
    members = X.checkpoint(members.join(count, "zone"))
    rows, columns = F.ceil(F.col("n_all") / BLOCK), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK)
    members = members.withColumns({"row": F.pmod(F.xxhash64("node"), rows), "column": F.pmod(F.xxhash64("node", F.lit(1)), columns), "rows": rows, "columns": columns}).join(sets, "node")
    left = members.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("side", F.lit(0))
    right = members.where("component <> main").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("side", F.lit(1))
    names = ["zone", "row", "column", "side", "node", "component", "shingles"]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        x, y = (block[block.side == i] for i in (0, 1))
        sizes = np.array([len(s) // 8 for s in x.shingles], np.int64)
        shingles = np.frombuffer(b"".join(x.shingles), U)
        order = np.argsort(shingles, kind="stable")
        shingles, of = shingles[order], np.repeat(np.arange(len(x)), sizes)[order]
        nodes, parts, out = x.node.to_numpy(), x.component.to_numpy(), []
        for node, part, own in zip(y.node, y.component, y.shingles, strict=True):
            own = np.frombuffer(own, U)
            low, high = np.searchsorted(shingles, own), np.searchsorted(shingles, own, "right")
            size = high - low
            hits = of[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
            both = np.bincount(hits, minlength=len(x))
            good = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (parts != part))
            good = good[np.unique(parts[good], return_index=True)[1]]
            out += [(min(node, o), max(node, o)) for o in nodes[good].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.select(names).unionByName(right.select(names)).groupBy("zone", "row", "column").applyInPandas(compare, "a long, b long").distinct()


def _found(docs: DataFrame, k: int, percent: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node, n_shingles; classes of equal sets: node, doc_id, component)."""
    X.tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = X.checkpoint(sketches(docs, k))
    least_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = rows.where("n_shingles > 0").groupBy("node").agg(least_id.alias("x"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = X.checkpoint(classes.select("node", "x.doc_id", "x.digest", "n_shingles", "registers"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.expr("registers").substr(i * WIDTH + 1, F.lit(WIDTH)), i))
    bands = classes.select("node", F.explode(keys).alias("key"))
    common = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    shared = X.checkpoint(bands.join(common, "key").select("key", "node", "low"))
    sets = X.checkpoint(_sets(docs, classes.select("node", "doc_id", "digest").join(shared.select("node").distinct(), "node"), k))
    # two leaders of each bucket; the other one differs by bucket
    turn = F.xxhash64(F.pmod("key", F.lit(4)))
    other = shared.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("turned")).select("key", F.col("turned").bitwiseXOR(turn).alias("other"))
    pairs = shared.select("node", F.col("low").alias("leader")).distinct().unionAll(shared.join(other, "key").select("node", F.col("other").alias("leader"))).where("node <> leader")
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    least = percent / 100 - margin
    pairs = X.checkpoint(_estimated(pairs, classes, percent, least))
    links = X.checkpoint(_confirmed(pairs, sets, percent))
    found = components(links)
    # members of one bucket that are still apart
    held = shared.select("key", "node", "low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = held.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    held = X.checkpoint(held.join(apart.select("key"), "key", "left_semi").select("node", "low", "component").distinct())
    if not held.isEmpty():
        found = components(links.unionByName(_across(held, sets, percent)))
    named = classes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    return rows, named


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, margin: float = 0.15) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles and component_id, the least id of those linked to it."""
    rows, named = _found(docs, k, percent, margin)
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least_id, "component").select("node", "component_id")
    return rows.select("doc_id", "node", "n_shingles").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, k: int = 5, percent: int = 80, margin: float = 0.15) -> DataFrame:
    """One row of docs, all columns, of each group of near copies: that with the least id (null only if all are).

    Of rows of a group that share the least id, the one whose set has the least hash stays, and of equal sets the one with
    the least text.  Rows without words all stay.  It is rows that are decided on, not ids.
    """
    _, named = _found(docs, k, percent, margin)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    node, own, own_id, rank = X.fresh(docs, "node", "own", "own_id", "rank")
    kept = first.select(F.col("x.node").alias(own), F.col("x.doc_id").alias(own_id))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_class(*shingle_sets(piece.column(at), k)))], [*names, node])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))
    # by set and id together: a group of copies is not dealt to one task, nor are the rows without words
    both = marked.join(kept, (F.col(node) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left")
    w = Window.partitionBy(node, "doc_id").orderBy("text")
    ranked = both.where(f"`{node}` = 0 or `{own}` is not null").withColumn(rank, F.row_number().over(w))
    return ranked.where(f"`{node}` = 0 or `{rank}` = 1").select(*(F.col(f"`{c}`") for c in names))
