"""Benchmark decontamination by winnowing.

The minimum of the hashes of k-grams in each sliding window of a text is its
fingerprint; with grams of 5 words in windows of 10, every span of 10 words has
one, and equal spans have equal ones.  Documents' fingerprints are joined to
those of the benchmark's windows by a shuffle; where they meet, the hits are
extended: a document's window counts if its whole word sequence (96 bits of its
hash) is a window of an item.

What the join has to move is cut down first by a bitmap of `bits` bits of the
benchmark's fingerprints, made by Spark's bitmap aggregates.  Its size is fixed,
so it can be broadcast; a benchmark that fills it makes the join larger, not
wrong.  Nothing else of the benchmark reaches the driver or every executor.

Nulls, empty texts and texts without words have no words and no hits; an item
with fewer words than a window is one window; items without words match
nothing.  Rows with equal or null ids are treated one by one; an item without id
is counted in hits, but not listed.  Empty tables have no hits.  Long texts are
in memory as a whole.  Columns named like results are replaced, others ignored or,
by clean(), kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import exchange as X
from factweave.llm.textops import ALNUM, U, covered, hashed_words, mix, mix1, owner, per_text, pieces, prefix_sums, sliding, windows

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _hashed(column) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(column, ALNUM, True)


def _second(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U(0xA5A5A5A5A5A5A5A5))


def fingerprints(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a text: its fingerprint, and where the window begins."""
    _, at = windows(hashes, first, window)
    grams = sliding(prefix_sums(hashes), gram)
    least = grams[at]
    for i in range(1, window - gram + 1):
        least = np.minimum(least, grams[at + i])
    return least, at


def _short(keys: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of a whole item of n words, fewer than a window."""
    return mix(keys + U(mix1(n)))


def _keys(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each run of n words that begins in at."""
    return sliding(prefix_sums(hashes), n)[at], (sliding(prefix_sums(_second(hashes)), n)[at] >> U(32)).astype("<u4")


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(print, words, key, second, item) of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                hashes, first = _hashed(piece.column(1))
                count, own = np.diff(first), owner(first)
                found = [(window, *fingerprints(hashes, first, window, gram))]
                for n in np.unique(count[(count > 0) & (count < window)]).tolist():
                    at = first[:-1][count == n]
                    found.append((n, _short(_keys(hashes, at, n)[0], n), at))
                for n, prints, at in found:
                    key, second = _keys(hashes, at, n) if len(at) else (np.zeros(0, U), np.zeros(0, "<u4"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(key.view(np.int64)), pa.array(second.astype(np.int64)), piece.column(0).take(pa.array(own[at]))],
                        ["print", "words", "key", "second", "item"],
                    )

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(run, "print long, words int, key long, second long, item string").distinct()


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Which of so many slots have a fingerprint."""
    slot = F.pmod("print", F.lit(bits))
    maps = prints.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    # at most bits / 32768 + 1 rows of 4 kB
    out = np.zeros((bits // 32768 + 2) * 32768, bool)
    for r in maps.collect():
        # parts count from 1, and a part's last slot is its first position
        begin = (r["part"] - 1) * 32768 + 1 if r["part"] > 0 else 0
        out[begin : begin + 32768] |= np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
    return np.packbits(out)


def _marked(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int, gram: int, bits: int, size: int = 4 << 20):
    """The exchange between documents, in chunks of so many bytes, and items: (chunks with answers, a function that gives each row's hits)."""
    X.tune(docs.sparkSession)
    items = X.checkpoint(item_windows(benchmark, window, gram))
    holder = docs.sparkSession.sparkContext.broadcast((_bitmap(items, bits), [r["words"] for r in items.select("words").distinct().collect()]))
    n = max(X.buckets(docs), X.buckets(items))
    chunked = X.chunks(docs, columns, size=size)

    def probes(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, fingerprints, where windows begin, hashes of words, first words) of windows that the bitmap lets through."""
        held, sizes = holder.value
        hashes, first = _hashed(table["text"])
        for k in sizes:
            if k == window:
                prints, at = fingerprints(hashes, first, window, gram)
            else:
                keys, at = windows(hashes, first, k)
                prints = _short(keys, k)
            slot = prints.view(np.int64) % bits
            some = np.flatnonzero((held[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            yield k, prints[some], at[some], hashes, first

    def asked(table: pa.Table, _):
        prints = np.unique(np.concatenate([p for _, p, _, _, _ in probes(table)] or [np.zeros(0, U)]))
        for b, s in X.by_bucket(prints, n):
            yield b, prints[s].tobytes()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(U)
            rows = [(b, -1, X.pack(pa.Table.from_batches([batch.take(pa.array(s))]))) for b, s in X.by_bucket(prints, n)]
            yield from X.payloads(rows)

    def met(rows: list[tuple[int, bytes]]):
        held = [X.unpack(p) for chunk, p in rows if chunk < 0]
        if not held:
            yield from (b"" for _ in rows)
            return
        held = pa.concat_tables(held)
        prints = held["print"].to_numpy().view(U)
        order = np.argsort(prints, kind="stable")
        prints, held = prints[order], held.take(pa.array(order))
        for chunk, p in rows:
            if chunk < 0:
                yield b""
                continue
            wanted = np.frombuffer(p, U)
            low, high = np.searchsorted(prints, wanted), np.searchsorted(prints, wanted, "right")
            size = high - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield X.pack(held.take(pa.array(at))) if len(at) else b""

    def hits(table: pa.Table, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(first words, which words are hit, items of each row)."""
        hashes, first = _hashed(table["text"])
        hit, names = np.zeros(len(hashes), bool), [set() for _ in range(table.num_rows)]
        if got:
            answer = pa.concat_tables([X.unpack(p) for p in got.values()])
            size, key, second = (answer[c].to_numpy() for c in ("words", "key", "second"))
            item, text = answer["item"].to_pylist(), owner(first)
            for k, _, at, _, _ in probes(table):
                own = np.flatnonzero(size == k)
                if not len(own) or not len(at):
                    continue
                order = own[np.argsort(key[own].view(U), kind="stable")]
                held = key[order].view(U)
                mine, more = _keys(hashes, at, k)
                low, high = np.searchsorted(held, mine), np.searchsorted(held, mine, "right")
                good = []
                for i in np.flatnonzero(high > low).tolist():
                    same = [order[j] for j in range(low[i], high[i]) if second[order[j]] == more[i]]
                    if same:
                        good.append(at[i])
                        names[text[at[i]]].update(item[j] for j in same)
                hit |= covered(np.array(good, np.int64), k, len(hashes))
        return first, hit, [sorted(x for x in own if x is not None) for own in names]

    answers = X.answered(X.dealt(X.asked(chunked, asked, n, deal=False).unionByName(items.mapInArrow(sent, X.ASKED)), n), met)
    return X.rejoined(chunked, answers), hits


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, bits: int = 1 << 24) -> DataFrame:
    """Per row of docs (doc_id, text): words, words hit, items that occur, whether any does."""
    joined, hits = _marked(docs.select("doc_id", "text"), benchmark, ["doc_id", "text"], window, gram, bits)

    def finish(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        first, hit, names = hits(table, got)
        n_hit = per_text(hit, first).astype(np.int64)
        return pa.table(
            {
                "doc_id": table["doc_id"].cast(pa.int64()), "n_words": np.diff(first), "n_hit": n_hit, "n_items": pa.array([len(x) for x in names], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), "contaminated": n_hit > 0,
            }
        )

    return X.finished(joined, finish, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, bits: int = 1 << 24) -> DataFrame:
    """The rows of docs without a benchmark window, all columns; each row is judged by its own text."""
    # whole rows are carried along, and four Python workers of an executor hold a chunk each
    joined, hits = _marked(docs, benchmark, docs.columns, window, gram, bits, size=2 << 20)

    def finish(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        first, hit, _ = hits(table, got)
        return table.filter(pa.array(per_text(hit, first) == 0))

    return X.finished(joined, finish, T.StructType(docs.schema.fields))
