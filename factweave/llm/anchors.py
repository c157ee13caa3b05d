"""Removal of repeated passages by fixed-block anchors.

Of two equal runs of 2B words, each holds a whole block of B words that begins
at a multiple of B in its document.  So the blocks of all documents are indexed
by hash, every rolling window of B words probes the index, and a run of 2B
words can only be repeated if it holds a window that hit a block of another
place.  Hits are extended on either side to all runs of 2B words around them,
and the runs' hashes (96 bits) decide which of them also start earlier; the
union of those is the maximal repeats.

Order is by id (nulls last), then by position; rows of one id (nulls too) are
ordered as they stand in the table.  Nulls and texts without words give no words
and an empty text.  A row's own text is never split, so a task needs some 60
bytes of memory for each byte of the longest text.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm import exchange as X
from factweave.llm.textops import SPACED, U, covered, flat, hashed_words, isin_sorted, mix, owner, per_text, prefix_sums, sliding, windows

SCHEMA = "doc_id long, n_words long, n_removed long, text string"
LAST = np.iinfo(np.int64).max


def pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """48 bits of hashes that, with the bucket, stand for them."""
    return (hashes >> U(16)) * U(n) + hashes % U(n)


def _second(hashes: np.ndarray, k: int) -> np.ndarray:
    """32 more bits for each run of k words, independent of the first 64."""
    return (sliding(prefix_sums(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5))), k) >> U(32)).astype("<u4")


def isin_pairs(keys: np.ndarray, second: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Whether keys and second occur together in payloads, each all second ones and then all keys."""
    if not payloads or not len(keys):
        return np.zeros(len(keys), bool)
    held = np.concatenate([np.frombuffer(p, "<u8", -1, len(p) // 3) for p in payloads])
    more = np.concatenate([np.frombuffer(p, "<u4", len(p) // 12) for p in payloads])
    order = np.lexsort((more, held))
    held, more = held[order], more[order]
    low, high = np.searchsorted(held, keys), np.searchsorted(held, keys, "right")
    out = np.zeros(len(keys), bool)
    while (low < high).any():  # once, but for keys that collide
        some = np.flatnonzero(low < high)
        out[some] |= more[low[some]] == second[some]
        low = low + 1
    return out


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(table["text"], SPACED, False)


def _order(table: pa.Table) -> np.ndarray:
    ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else table["doc_id"].fill_null(LAST).to_numpy()
    return ids.astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per row of docs (doc_id, text): words, words removed, and the words kept, joined by one space."""
    block = window // 2
    X.tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = X.buckets(docs)
    chunked = X.chunks(docs, ["doc_id", "text"])

    def probes(table: pa.Table, _):
        hashes, first = _words(table)
        runs, at = windows(hashes, first, block)
        indexed = (at - first[owner(first)[at]]) % block == 0
        order = np.argsort(runs)
        runs, indexed = runs[order], indexed[order]
        new = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1]))) if len(runs) else np.zeros(0, np.int64)
        if not len(new):
            return
        again = np.diff(np.append(new, len(runs))) > 1
        indexed = np.logical_or.reduceat(indexed, new)
        keys = runs[new]
        for b, s in X.by_bucket(keys, n):
            yield b, np.packbits(np.concatenate((again[s], indexed[s]))).tobytes() + pack48(keys[s] >> U(16))

    def hits(rows):
        keys, again, indexed = [], [], []
        for _, p in rows:
            k = len(p) * 4 // 25  # 6 bytes and 2 bits each
            while -(-2 * k // 8) + 6 * k > len(p):
                k -= 1
            while -(-2 * k // 8) + 6 * k < len(p):
                k += 1
            bits = np.unpackbits(np.frombuffer(p, np.uint8, -(-2 * k // 8)), count=2 * k).astype(bool)
            keys.append(unpack48(p[-6 * k :]))
            again.append(bits[:k])
            indexed.append(bits[k:])
        whole, part = X.joined_keys(keys)
        order = np.argsort(whole, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], whole[order][1:] != whole[order][:-1])))
        size = np.diff(np.append(new, len(whole)))
        found = ((size > 1) | np.logical_or.reduceat(np.concatenate(again)[order], new)) & np.logical_or.reduceat(np.concatenate(indexed)[order], new)
        hit = np.zeros(len(whole), bool)
        hit[order] = np.repeat(found, size)
        for i in range(len(rows)):
            yield pack48(keys[i][hit[_slice(part, i)]])

    def extended(table: pa.Table, got):
        hashes, first = _words(table)
        held = np.sort(np.concatenate([unpack48(p) * U(n) + U(b) for b, p in got.items()])) if got else np.zeros(0, U)
        if not len(held):
            return
        runs, at = windows(hashes, first, block)
        hit = np.zeros(len(hashes) + 1, np.int64)
        hit[at[isin_sorted(_short(runs, n), held)] + 1] = 1
        hit = np.cumsum(hit)
        runs, at = windows(hashes, first, window)
        near = hit[at + window - block + 1] > hit[at]
        if not near.any():
            return
        runs, second, ids = runs[near], _second(hashes, window)[at[near]], _order(table)[owner(first)[at[near]]]
        order = np.lexsort((ids, second, runs))
        runs, second, ids = runs[order], second[order], ids[order]
        new = np.concatenate(([True], (runs[1:] != runs[:-1]) | (second[1:] != second[:-1])))
        runs, second, ids = runs[new], second[new], ids[new]
        base = ids.min()
        wide = "<u4" if float(ids.max()) - float(base) < 2**32 - 1 else "<i8"
        base = np.int64(base if wide == "<u4" else 0)
        for b, s in X.by_bucket(runs, n):
            yield b, base.tobytes() + (b"4" if wide == "<u4" else b"8") + (ids[s] - base).astype(wide).tobytes() + second[s].tobytes() + runs[s].tobytes()

    def later(rows):
        keys, seconds, ids = [], [], []
        for _, p in rows:
            base, wide = int(np.frombuffer(p, np.int64, 1)[0]), 4 if p[8:9] == b"4" else 8
            k = (len(p) - 9) // (12 + wide)
            ids.append(np.frombuffer(p, "<u4" if wide == 4 else "<i8", k, 9).astype(np.int64) + base)
            seconds.append(np.frombuffer(p, "<u4", k, 9 + wide * k))
            keys.append(np.frombuffer(p, "<u8", k, 9 + (wide + 4) * k))
        whole, part = X.joined_keys(keys)
        second = np.concatenate(seconds)
        order = np.lexsort((part, np.concatenate(ids), second, whole))
        gone = np.zeros(len(whole), bool)
        gone[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (second[order][1:] == second[order][:-1])
        for i, k in enumerate(keys):
            own = gone[_slice(part, i)]
            yield seconds[i][own].tobytes() + k[own].tobytes()

    def cut(table: pa.Table, got) -> pa.Table:
        hashes, first = _words(table)
        runs, at = windows(hashes, first, window)
        second = _second(hashes, window)[at]
        gone = isin_pairs(runs, second, list(got.values()))
        order = np.lexsort((_order(table)[owner(first)[at]], second, runs))
        gone[order[1:]] |= (runs[order][1:] == runs[order][:-1]) & (second[order][1:] == second[order][:-1])
        drop = covered(at[gone], window, len(hashes))
        removed = per_text(drop, first)
        data, off = flat(table["text"])
        kept = []
        for d in range(len(first) - 1):
            tokens = data[off[d] : off[d + 1]].tobytes().split()
            kept.append(b" ".join(compress(tokens, ~drop[first[d] : first[d + 1]]) if removed[d] else tokens))
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": np.diff(first), "n_removed": removed.astype(np.int64), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    hit = X.answered(X.asked(chunked, probes, n), hits)
    gone = X.answered(X.asked(X.rejoined(chunked, hit), extended, n), later)
    return X.finished(X.rejoined(chunked, gone), cut, SCHEMA)


def _slice(part: np.ndarray, i: int) -> slice:
    return slice(*np.searchsorted(part, (i, i + 1)))
