"""Similarity join of documents on their word n-grams, by prefixes under several global orders.

A document is the set of its shingles; equal sets are one class.  If two sets are
similar enough, then under any order of all shingles each has one of the other's
shingles in its prefix (its size less the overlap that it must have, and one).  Here
are three orders, rare shingles first in all: by eighths of a power of two of the
number of sets that hold a shingle, by coarser classes of it, and by whether it is
more than one; ties are in order of three different hashes.  A pair must meet in its
prefixes under every order before its sets are compared.

The numbers of sets come from an exchange over all documents.  Only shingles of more
than one set can be shared; a set with too few of them has no partner.  The others
put their prefixes' shared shingles into posting lists.  First each set is compared
with two leaders of its lists, which joins most copies.  A list that is still in
more than one component is taken apart: one of up to SHORT sets into its pairs
across components; the sets of longer ones go on to the lists of the next order,
where any pair that only long lists have must meet again.  What only long lists of
all orders hold is compared in blocks of full sets, without making pairs.  So no
pair is lost and no list is squared.  Components come from the star steps of
`setsketch`.

Nulls and texts without words have empty sets and are linked with nothing; a text
with fewer words than a shingle is one shingle.  Rows with equal or null ids are
treated one by one; a null id is the least of a component only if it has no other.
An empty table gives an empty one.  Texts are in memory a few megabytes at a time, a
longer one as a whole.  Shingles with equal 64-bit hashes are taken as equal.  Other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import exchange as X
from factweave.llm.setsketch import _across, _apart, _class, _confirmed, components, shingle_sets
from factweave.llm.textops import U, mix, mix1, owner, per_text

ORDERS = ("first", "second", "third")
#: Sets of a list whose pairs are made.
SHORT = 32


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of this size shares with any similar one."""
    return -(-percent * size // 100)


def levels(count: np.ndarray) -> np.ndarray:
    """Eighths of powers of two of how many sets hold a shingle; 0 for one set."""
    return np.minimum(np.ceil(8 * np.log2(count)), 255).astype(np.uint8)


def ranks(shingles: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """The place of shingles in a global order: by class of their number of sets, then by a hash of the order's own."""
    kind = (level, np.where(level > 0, 1 + level // 24, 0), np.minimum(level, 1))[order].astype(U)
    return (kind << U(56)) | (mix(shingles + U(mix1(order + 101))) >> U(8))


def prefixes(held: np.ndarray, first: np.ndarray, level: np.ndarray, percent: int, order: int) -> list[np.ndarray]:
    """Of each set, the shingles of its prefix that other sets have too."""
    size = np.diff(first)
    text = owner(first)
    by = np.lexsort((ranks(held, level, order), text))
    place = np.arange(len(held)) - first[:-1][text]
    inside = (place < (size - needed(size, percent) + 1)[text]) & (level[by] > 0)
    at = np.flatnonzero(inside)
    return np.split(held[by[at]], np.searchsorted(text[at], np.arange(1, len(size))))


def _selected(held: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets with these numbers."""
    size = np.diff(first)[which]
    begin = np.cumsum(size) - size
    return held[np.repeat(first[which] - begin, size) + np.arange(size.sum())], np.append(begin, size.sum())


def _marked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, node (its class; 0 for none), n_shingles; with a chunk's first row of a class that may have partners, its prefixes and shingles."""
    n = X.buckets(docs)
    chunked = X.chunks(docs, ["doc_id", "text"], size=2 << 20)

    def sets(table: pa.Table):
        """(node of each row, sizes, rows that are the first of their class, their shingles)."""
        held, first = shingle_sets(table["text"], k)
        node = _class(held, first)
        which = np.sort(np.unique(node, return_index=True)[1])
        which = which[node[which] != 0]
        return node, np.diff(first), which, *_selected(held, first, which)

    def keys(held: np.ndarray) -> np.ndarray:
        return (held >> U(32)).astype("<u4")

    def ask(table: pa.Table, _):
        shingles, count = np.unique(sets(table)[3], return_counts=True)
        count = np.minimum(count, 255).astype(np.uint8)
        for b, s in X.by_bucket(shingles, n):
            yield b, len(s).to_bytes(4, "little") + keys(shingles[s]).tobytes() + zlib.compress(count[s].tobytes(), 1)

    def answer(rows: list[tuple[int, bytes]]):
        # a payload is the number of keys, the keys, and how many sets of the chunk have each
        size = [int.from_bytes(p[:4], "little") for _, p in rows]
        every = np.concatenate([np.frombuffer(p, "<u4", m, 4) for (_, p), m in zip(rows, size)])
        count = np.concatenate([np.frombuffer(zlib.decompress(p[4 + 4 * m :]), np.uint8) for (_, p), m in zip(rows, size)])
        own, back = np.unique(every, return_inverse=True)
        level = levels(np.bincount(back, count, len(own)))[back]
        cut = np.cumsum([0, *size])
        for low, high in zip(cut[:-1], cut[1:]):
            yield zlib.compress(level[low:high].tobytes(), 1)

    def finish(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        node, size, which, held, first = sets(table)
        shingles, back = np.unique(held, return_inverse=True)
        level = np.zeros(len(shingles), np.uint8)
        for b, s in X.by_bucket(shingles, n):
            level[s] = np.frombuffer(zlib.decompress(got[b]), np.uint8)
        level = level[back]
        able = per_text(level > 0, first) >= needed(np.diff(first), percent)
        level = level[np.repeat(able, np.diff(first))]
        which = which[able]
        held, first = _selected(held, first, np.flatnonzero(able))
        lists = [prefixes(held, first, level, percent, order) for order in range(len(ORDERS))]
        out = {"doc_id": table["doc_id"], "node": node, "n_shingles": size.astype(np.int64)}
        full = [i for i in range(len(which)) if all(len(x[i]) for x in lists)]
        place = {int(which[i]): i for i in full}
        for name, own in zip(ORDERS, lists):
            out[name] = pa.array([own[place[r]].view(np.int64) if r in place else None for r in range(len(node))], pa.list_(pa.int64()))
        out["shingles"] = pa.array([held[first[place[r]] : first[place[r] + 1]].tobytes() if r in place else None for r in range(len(node))], pa.binary())
        return pa.table(out)

    joined = X.rejoined(chunked, X.answered(X.asked(chunked, ask, n), answer))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("node long, n_shingles long, first array<long>, second array<long>, third array<long>, shingles binary").fields])
    return X.finished(joined, finish, schema)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those of sizes that allow the similarity and with a shingle of both prefixes under every order, by 32 bits."""
    short = lambda o: F.transform(o, lambda x: F.shiftright(x, 32).cast("int"))
    sides = [sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"size_{x}"), *(short(o).alias(f"{o}_{x}") for o in ORDERS)) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    for o in ORDERS:
        both = both.where(F.arrays_overlap(f"{o}_a", f"{o}_b"))
    return both.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)").select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are similar."""
    return X.checkpoint(_confirmed(_near(pairs, sets, percent), sets.select("node", "shingles"), percent))


def _pairs(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _led(sets: DataFrame) -> DataFrame:
    """Each set with two leaders of its lists of the first order; the second one differs by list."""
    lists = sets.select("node", F.explode(ORDERS[0]).alias("shingle"))
    turn = F.xxhash64(F.pmod("shingle", F.lit(4)))
    lead = lists.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.col("node").bitwiseXOR(turn)).alias("turned")).where("low <> high")
    lead = _apart(lead.select("shingle", "low", F.col("turned").bitwiseXOR(turn).alias("other")), "shingle")
    both = lists.join(lead, "shingle").select("node", F.explode(F.array("low", "other")).alias("leader")).where("node <> leader")
    return both.select(*_pairs("node", "leader")).distinct()


def _lists(sets: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Of lists of this order that hold several components: (pairs across components in short ones, rows of the long ones)."""
    lists = sets.select("node", "component", F.explode(order).alias("shingle"))
    count = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    lists = X.checkpoint(lists.join(_apart(count.select("shingle", "n", "low"), "shingle"), "shingle"))
    short = lists.where(F.col("n") <= SHORT).select("shingle", "node", "component")
    other = short.select("shingle", F.col("node").alias("other"), F.col("component").alias("apart"))
    pairs = short.join(other, "shingle").where("node < other and component <> apart").select(*_pairs("node", "other")).distinct()
    return pairs, lists.where(F.col("n") > SHORT).select("node", "component", "low")


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles and component_id, the least id that links of sets with 100 * intersection >= percent * union reach."""
    X.tune(docs.sparkSession)
    rows = X.checkpoint(_marked(docs.select("doc_id", "text"), k, percent))
    sets = X.checkpoint(rows.where("shingles is not null").select("node", "n_shingles", *ORDERS, "shingles").dropDuplicates(["node"]))
    links = _linked(_led(sets), sets, percent)
    found = components(links)
    held = sets.select("node", "n_shingles", *ORDERS)
    held = X.checkpoint(held.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    apart, rest = None, None
    for order in ORDERS:
        pairs, long = _lists(held, order)
        apart = pairs if apart is None else apart.unionByName(pairs)
        if long.isEmpty():
            break
        long = X.checkpoint(long.distinct())
        held = held.join(long.select("node").distinct(), "node", "left_semi")
    else:
        rest = _across(long, sets.select("node", "shingles"), percent)
    more = _linked(apart.distinct(), sets, percent)
    more = more if rest is None else X.checkpoint(more.unionByName(rest))
    if not more.isEmpty():
        # components are stars already
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    least = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    named = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("component_id").alias("component_id"))
    named = named.select("node", "component").join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "node", "n_shingles").join(_apart(named, "node"), "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
