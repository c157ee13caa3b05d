"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision has a context tree over the
`DEPTH` bytes before it.  A node keeps how often training took either branch,
estimates the next branch as Krichevsky and Trofimov do, and weighs its own
estimate against its children's by the probability each gave the training data:
P_w = (P_e + product of children's P_w) / 2.  A decision's probability mixes the
estimates on its path with these weights; the mixing ends at the deepest node
that training reached.  Texts are lower-cased (A-Z), preceded by DEPTH zero
bytes and followed by one, which stands for the end.

Counts of all training texts are gathered by the two bytes before the decision:
one bucket has a whole subtree from depth 2 on.  Depths 0 and 1 have at most
256 x 255 nodes and go through the driver.  Nothing else is collected, and the
model is never broadcast: chunks ask for the code lengths of their distinct
grams.

Next to it stands the base, an add-half unigram model of words.

Nulls and empty texts consist of the end alone.  A null id counts as training.
Repeated rows and ids are separate texts, equal texts get equal scores.  With no
training text every decision is a coin toss.  A text is in memory as a whole, with
some 60 bytes a byte.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import exchange as X
from factweave.llm.anchors import _slice
from factweave.llm.textops import LOWER, SPACED, U, flat, hashed_words, mix, per_text, pieces

DEPTH = 5
#: Bytes of text a chunk has, and how many are looked at together.
CHUNK, SLICE = 16 << 20, 1 << 20
SCHEMA = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def remainders(ids: list, n: int = 5) -> np.ndarray:
    """crc32 of each id as text, modulo n; -1 for a null."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % n for i in ids], np.int64)


def _pack(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    more = counts[counts >= 255].astype("<u8")
    return struct.pack("<II", len(keys), len(more)) + np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() + small.tobytes() + more.tobytes()


def _unpack(data: bytes, at: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    n, m = struct.unpack_from("<II", data, at)
    at += 8
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(data, "<u8", m, at).astype(np.int64)
    return keys.view("<u8").ravel(), counts, at + 8 * m


def _grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and byte of each position (the byte last), each text's end included, and where each text's begin."""
    data, off = flat(table["text"])
    n = len(off) - 1
    size = np.diff(off)
    stream = np.zeros(len(data) + DEPTH * (n + 1), np.uint8)
    own = np.zeros(len(stream), bool)
    own[np.arange(len(data)) + DEPTH * (np.repeat(np.arange(n), size) + 1)] = True
    stream[own] = LOWER[data]
    first = off + np.arange(n + 1)
    # a gram's last byte: the text's own and the zero after it
    own[off[1:] + DEPTH * np.arange(1, n + 1)] = True
    whole = len(stream) - DEPTH
    out = np.zeros(whole, U)
    for i in range(DEPTH + 1):
        out <<= U(8)
        out |= stream[i : whole + i]
    return out[own[DEPTH:]], first, size


def _context(keys: np.ndarray) -> np.ndarray:
    """What decides about a gram's bucket: the two bytes before the last."""
    return mix((keys >> U(8)) & U(0xFFFF))


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and how often each is in training."""
    both, count = np.unique((keys << U(1)) | train.astype(U), return_counts=True)
    new = np.concatenate(([True], both[1:] >> U(1) != both[:-1] >> U(1)))[: len(both)]
    counts = np.zeros(int(new.sum()), np.int64)
    odd = (both & U(1)) == 1
    counts[(np.cumsum(new) - 1)[odd]] = count[odd]
    return both[new] >> U(1), counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts, once each, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[new], np.add.reduceat(counts[order], new) if len(new) else counts


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(shift)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.astype(float), b.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


class Level:
    """Nodes of one depth: key (context << 8 | decision), counts, own and weighted log probability."""

    def __init__(self, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray | None):
        self.keys, self.zero, self.one = keys, zero, one
        own = kt(zero, one)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.own = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.weighted)
        self.p = (one + 0.5) / (zero + one + 1.0)

    def up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts and product of these nodes by parent key."""
        held, group = np.unique(keys, return_inverse=True)
        return held, *(np.bincount(group, x, len(held)) for x in (self.zero, self.one, self.weighted))


def _decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram and bit: the node's number below its context, and the branch."""
    byte = (keys & U(0xFF)).astype(np.int64)[:, None]
    bit = np.arange(8)
    return (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


def subtree(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels DEPTH down to 2 of training grams; their deepest first."""
    seen = counts > 0
    node, branch = _decisions(keys[seen])
    full = ((keys[seen] >> U(8) << U(8))[:, None] | node.astype(U)).ravel()
    held, group = np.unique(full, return_inverse=True)
    weight = np.repeat(counts[seen], 8).astype(float)
    one = np.bincount(group, weight * branch.ravel(), len(held))
    zero = np.bincount(group, weight, len(held)) - one
    levels = [Level(held, zero, one, None)]
    for depth in range(DEPTH - 1, 1, -1):
        low = (U(1) << U(8 * depth + 8)) - U(1)
        held, zero, one, below = levels[-1].up(levels[-1].keys & low)
        levels.append(Level(held, zero, one, below))
    return levels


class Top:
    """Depths 0 and 1, in arrays of 256 contexts x 256 decisions."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        zero, one, below = (np.zeros((256, 256)) for _ in range(3))
        for key, a, b, w in rows:
            zero[key >> 8, key & 255], one[key >> 8, key & 255], below[key >> 8, key & 255] = a, b, w
        first = Level(np.arange(65536), zero.ravel(), one.ravel(), below.ravel())
        root = Level(np.arange(256), zero.sum(0), one.sum(0), first.weighted.reshape(256, 256).sum(0))
        self.seen1 = (zero + one) > 0
        self.seen0 = (root.zero + root.one) > 0
        self.own0, self.p0, self.own1, self.p1 = root.own, root.p, first.own.reshape(256, 256), first.p.reshape(256, 256)


def code_lengths(keys: np.ndarray, levels: list[Level], top: Top) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others."""
    node, branch = _decisions(keys)
    context = ((keys >> U(8)) & U(0xFF)).astype(np.int64)[:, None]
    # weight still to give, probability of a one so far, probability at the deepest node seen
    p = np.zeros(node.shape)
    left = np.ones(node.shape)
    path = [(top.seen0[node], top.own0[node], top.p0[node]), (top.seen1[context, node], top.own1[context, node], top.p1[context, node])]
    for depth, level in zip(range(2, DEPTH + 1), reversed(levels), strict=True):
        low = (U(1) << U(8 * depth + 8)) - U(256)
        want = ((keys & low)[:, None] | node.astype(U)).ravel()
        at = np.minimum(np.searchsorted(level.keys, want), max(len(level.keys) - 1, 0))
        seen = (level.keys[at] == want) if len(level.keys) else np.zeros(len(want), bool)
        own, est = (level.own[at], level.p[at]) if len(level.keys) else (np.ones(len(want)), np.full(len(want), 0.5))
        path.append(tuple(x.reshape(node.shape) for x in (seen, own, est)))
    path.append((np.zeros(node.shape, bool), None, None))
    for i, (seen, own, est) in enumerate(path[:-1]):
        if not i:
            p = np.where(seen, 0, 0.5)
            left = np.where(seen, 1.0, 0)
        last = seen & ~path[i + 1][0]
        share = np.where(last, 1.0, own)
        p = p + np.where(seen, left * share * est, 0)
        left = np.where(seen, left * (1 - share), left)
    return np.log10(np.where(branch == 1, p, 1 - p)).sum(1)


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Per row of docs (doc_id, text): score and base_score, learnt from rows whose crc32(doc_id as text) mod folds isn't held."""
    X.tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = X.buckets(docs)
    chunked = X.chunks(docs, ["doc_id", "text"], size=CHUNK)

    def training(table: pa.Table) -> np.ndarray:
        return remainders(table["doc_id"].to_pylist(), folds) != held

    def tokens(table: pa.Table):
        hashes, first = hashed_words(table["text"], SPACED, True)
        return hashes >> U(8), first

    def slices(table: pa.Table):
        for batch in table.combine_chunks().to_batches():
            yield from (pa.Table.from_batches([x]) for x in pieces(batch, "text", SLICE))

    def counts(table: pa.Table, _):
        grams, known = [], []
        for part in slices(table):
            train = training(part)
            keys, first, _ = _grams(part)
            grams.append(_distinct(keys, np.repeat(train, np.diff(first))))
            keys, first = tokens(part)
            known.append(_distinct(keys, np.repeat(train, np.diff(first))))
        grams, seen = _merged(grams)
        known, often = _merged(known)
        own, own2 = dict(X.by_bucket(_context(grams), n)), dict(X.by_bucket(known, n))
        none = np.zeros(0, np.int64)
        for b in sorted(own.keys() | own2.keys()):
            s, s2 = own.get(b, none), own2.get(b, none)
            yield b, _pack(grams[s], seen[s], DEPTH + 1) + _pack(known[s2], often[s2], 7)

    def bucket(rows):
        grams, words_ = [], []
        for _, p in rows:
            g, c, at = _unpack(p, 0, DEPTH + 1)
            grams.append((g, c))
            words_.append(_unpack(p, at, 7)[:2])
        return grams, words_

    def summed(parts):
        whole, part = X.joined_keys([k for k, _ in parts])
        held_, group = np.unique(whole, return_inverse=True)
        return held_, np.bincount(group, np.concatenate([c for _, c in parts]), len(held_)).astype(np.int64), group, part

    gathered = X.checkpoint(X.asked(chunked, counts, n))

    def statistics(batches):
        for _, rows in X.by_turns(batches):
            grams, words_ = bucket(rows)
            keys, seen, _, _ = summed(grams)
            top = subtree(keys, seen)[-1]
            held_, *rest = top.up((((top.keys >> U(8)) & U(0xFF)) << U(8)) | (top.keys & U(0xFF)))
            _, often, _, _ = summed(words_)
            held_ = np.append(held_.astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(held_, pa.int64()), *(pa.array(np.append(x, y)) for x, y in zip(rest, (float((often > 0).sum()), float(often.sum()), 0.0), strict=True))], ["key", "a", "b", "w"])

    top = gathered.mapInArrow(statistics, "key long, a double, b double, w double").groupBy("key").agg(*(F.sum(c).alias(c) for c in "abw")).collect()
    distinct, total = next(((r["a"], r["b"]) for r in top if r["key"] == -1), (0.0, 0.0))
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != held, F.lit(True))).count()
    total, distinct = int(total) + ends, int(distinct) + (ends > 0)
    scale = total + 0.5 * (distinct + 1)
    model = docs.sparkSession.sparkContext.broadcast(Top([(r["key"], r["a"], r["b"], r["w"]) for r in top if r["key"] >= 0]))

    def replies(rows):
        grams, words_ = bucket(rows)
        keys, seen, group, part = summed(grams)
        length = code_lengths(keys, subtree(keys, seen), model.value).astype("<f4")[group]
        _, often, group2, part2 = summed(words_)
        often = often[group2]
        for i in range(len(rows)):
            c = often[_slice(part2, i)]
            yield struct.pack("<I", len(c)) + np.minimum(c, 2**32 - 1).astype("<u4").tobytes() + length[_slice(part, i)].tobytes()

    def scores(table: pa.Table, got) -> pa.Table:
        known = np.unique(np.concatenate([np.unique(tokens(part)[0]) for part in slices(table)]))
        distinct_ = np.unique(np.concatenate([np.unique(_grams(part)[0]) for part in slices(table)]))
        own, own2 = dict(X.by_bucket(known, n)), dict(X.by_bucket(_context(distinct_), n))
        none = np.zeros(0, np.int64)
        often, length = np.zeros(len(known), np.int64), np.zeros(len(distinct_))
        for b, p in got.items():
            (k,) = struct.unpack_from("<I", p)
            often[own.get(b, none)] = np.frombuffer(p, "<u4", k, 4)
            length[own2.get(b, none)] = np.frombuffer(p, "<f4", -1, 4 + 4 * k)
        return pa.concat_tables(scored(part, known, often, distinct_, length) for part in slices(table))

    def scored(part: pa.Table, known, often, distinct_, length) -> pa.Table:
        train = training(part)
        grams, first, size = _grams(part)
        text = np.repeat(np.arange(len(size), dtype=U), np.diff(first))
        own, times = np.unique((text << U(8 * DEPTH + 8)) | grams, return_counts=True)
        text, grams = (own >> U(8 * DEPTH + 8)).astype(np.int64), own & ((U(1) << U(8 * DEPTH + 8)) - U(1))
        score_ = np.bincount(text, times * length[np.searchsorted(distinct_, grams)], len(size))
        hashes, start = tokens(part)
        c = often[np.searchsorted(known, hashes)]
        n_tokens = np.diff(start) + 1
        base = per_text(np.log10(c + 0.5), start) + np.log10(ends + 0.5) - n_tokens * np.log10(scale)
        return pa.table(
            {
                "doc_id": part["doc_id"].cast(pa.int64()), "held_out": ~train, "n_bytes": size, "n_tokens": n_tokens, "n_known": per_text((c > 0).astype(np.int64), start) + (ends > 0),
                "train_tokens": np.full(len(size), total), "base_score": base, "score": score_, "bits_per_byte": -score_ / np.log10(2) / (size + 1),
            }
        )

    return X.finished(X.rejoined(chunked, X.answered(gathered, replies)), scores, SCHEMA)
