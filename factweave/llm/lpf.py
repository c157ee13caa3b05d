"""Removal of repeated byte strings by longest-previous-factor arrays.

With suffixes in order, the longest string at a position that also starts
earlier is shared with the previous or with the next smaller position, whichever
has the longer common prefix; likewise the longest one that also starts later with
the previous or next larger one.  A byte is removed only where one of these factors
says so.

A suffix array of a whole corpus fits no machine.  So each text is first cut at
the minimum of its 100-byte hashes in every 200-byte window: equal windows have
it at the same place, and all windows with the same minimum make one region.  A
first exchange of hashes leaves out regions whose minimum occurs once, and says
which regions occur twice as a whole.  Their bytes, of two copies each, and those of
the regions whose minimum has other company, are sent to the bucket of their
group, and all that may share a window meet there.  Whole regions are put in order
and must share their whole length with a neighbour; of the others each window is a
suffix, ordered by doubling, whose factor must reach the window's length.

A group is a minimum.  One that more than HOT different regions have, as those at
the ends of a passage that is quoted everywhere, is split: windows with 2**i bytes
and more before the minimum and 2**j and more behind it are grouped by these bytes.

Texts are looked at a megabyte at a time, so memory beyond a text's own bytes
doesn't grow with its length.

With keep_first, the first copy of each window (by id, nulls last, then
position) stays.  Nulls are empty texts; texts shorter than a window lose
nothing; rows with equal ids are separate documents, in the order of the table.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factweave.llm import exchange as X
from factweave.llm.anchors import _order, _slice, isin_pairs, pack48, unpack48
from factweave.llm.textops import U, flat, mix, per_text, prefix_sums, sliding, spans

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
#: Bytes of a text that are looked at together, and of regions whose suffixes are put in order together.
SEGMENT = 1 << 20
#: Different regions of one minimum that are one group.
HOT = 4096
#: What an exchange says of a region: it occurs twice; its minimum has other company; this chunk is one of the first two
#: that have it; it is the first; its minimum is hot.
TWICE, COMPANY, OWNER, FIRST, SPLIT = 1, 2, 4, 8, 16


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    held = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1])))
    return rank


def _smaller(sa: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the last one before it with a smaller position (-1: none)."""
    cand = np.arange(len(sa)) - 1
    todo = np.arange(len(sa))
    while len(todo):
        c = cand[todo]
        todo = todo[(c >= 0) & (sa[np.maximum(c, 0)] > sa[todo])]
        cand[todo] = cand[cand[todo]]
    return cand


def reaching(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous factor at each of the positions at (ascending) reaches length, and the longest later one.

    The suffixes there are put in order as far as length, ties by position; a suffix that shares length bytes with an
    earlier one shares them with its previous or next smaller position.
    """
    n = len(data)
    size = 8 if length >= 8 else 1
    padded = np.concatenate((data, np.zeros(size, np.uint8))).astype(U)
    rank = np.zeros(n, U)
    for i in range(size):
        rank = (rank << U(8)) | padded[i : n + i]
    rank = _dense(rank)
    while size * 2 <= length:
        beyond = np.zeros(n, np.int64)
        if size < n:
            beyond[:-size] = rank[size:] + 1
        rank, size = _dense((rank.astype(U) << U(32)) | beyond.astype(U)), size * 2
    prefix = _dense((rank[at].astype(U) << U(32)) | rank[at + length - size].astype(U))
    sa = np.argsort(prefix, kind="stable")
    out = []
    for sign in (1, -1):
        best = np.zeros(len(at), bool)
        for order in (sa, sa[::-1]):
            held = _smaller(order * sign)
            some = held >= 0
            best[order[some]] |= prefix[order[some]] == prefix[order[held[some]]]
        out.append(best)
    return out[0], out[1]


def whole(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of data that begin there share all their bytes with an earlier or a later one.

    They are put in order, ties by position, so the previous and the next smaller and larger ones are neighbours.
    """
    width = int(size.max(initial=0)) + 1
    held = np.zeros((len(begin), width), np.uint8)
    row = np.repeat(np.arange(len(begin)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    held[row, column] = data[np.repeat(begin, size) + column]
    held[np.arange(len(begin)), size] = 1  # an end, so that closing zeros count
    text = held.reshape(-1).view(f"S{width}")
    order = np.argsort(text, kind="stable")
    same = text[order[1:]] == text[order[:-1]]
    out = np.zeros(len(begin), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


class Regions:
    """The regions of a chunk's texts: windows [low, high], where their minimum is, its hash and their bytes' hash."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.data, self.off = flat(table["text"])
        found = [self._segment(a) for a in range(0, len(self.data), SEGMENT)]
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
        self.low, self.high, self.at, self.anchor, self.region = (np.concatenate(x) for x in zip(none, *found))
        order = np.lexsort((self.region, self.anchor))
        a, r = self.anchor[order], self.region[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])))[: len(a)]
        self.kind = np.empty(len(a), np.int64)  # of each region, its number among the distinct ones
        self.kind[order] = np.cumsum(first) - 1
        self.first = order[first]  # one region of each kind
        self.count = np.bincount(self.kind, minlength=len(self.first))

    def _segment(self, begin: int) -> tuple[np.ndarray, ...]:
        """The regions of windows that begin in a segment; where it ends, a region does."""
        window, gram = self.window, self.window // 2
        end = min(begin + SEGMENT, len(self.data))
        sums = prefix_sums(self.data[begin : end + window - 1].astype(U) + U(1))
        low = np.maximum(self.off[:-1], begin)
        count = np.maximum(np.minimum(self.off[1:] - window + 1, end) - low, 0)
        at = np.arange(count.sum()) + np.repeat(low - begin - np.cumsum(count) + count, count)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
        grams = sliding(sums, gram)
        least = (grams >> U(32) << U(32)) | np.arange(len(grams), dtype=U)
        done, wide = 1, window - gram + 1
        while done < wide:
            step = min(done, wide - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        where = (least[at] & U(0xFFFFFFFF)).astype(np.int64)
        # windows of one text with one minimum follow each other
        turn = np.concatenate(([True], where[1:] != where[:-1]))
        start = np.cumsum(count)[:-1]
        turn[start[start < len(at)]] = True
        new = np.flatnonzero(turn)
        low, high = at[new], at[np.append(new[1:], len(at)) - 1]
        return low + begin, high + begin, where[new] + begin, grams[where[new]], spans(sums, low, high + window)

    def split(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, kinds) by anchor."""
        return X.by_bucket(self.anchor[self.first], n)

    def codes(self, got: dict[int, bytes], n: int) -> np.ndarray:
        """What companies() says of each kind."""
        out = np.zeros(len(self.first), np.uint8)
        for b, s in self.split(n):
            if b in got:
                out[s] = np.frombuffer(got[b], np.uint8)
        return out

    def starts(self, regions: np.ndarray) -> np.ndarray:
        """Where the windows of regions begin."""
        size = self.high[regions] - self.low[regions] + 1
        return np.repeat(self.low[regions] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def keys(self, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(where they begin, hashes, 32 more bits) of windows (ascending), some at a time."""
        for begin in self.parts(begins, begins):
            low = begin[0]
            values = self.data[low : begin[-1] + self.window].astype(U) + U(1)
            first, second = (spans(prefix_sums(v), begin - low, begin - low + self.window) for v in (values, mix(values)))
            yield begin, first, (second >> U(32)).astype("<u4")

    def parts(self, items: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
        """Items whose places (ascending) are in one segment."""
        yield from (x for x in np.split(items, np.flatnonzero(np.diff(place // SEGMENT)) + 1) if len(x))

    def stretches(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the chunk sends: (group, first window, last window, kind of region, what for).

        A stretch is sent to be judged window by window (1), as one of two copies of a whole region (2), or only to be met
        by others' windows (3); with 4 no bytes are sent, and the region is judged by its owners' copies.
        """
        own = mix(self.anchor[self.first] ^ mix(self.region[self.first]))
        kinds = np.arange(len(code))
        twice = (code & TWICE) > 0
        rows = []
        owned = kinds[twice & ((code & OWNER) > 0)]
        rows.append((own[owned], self.low[self.first[owned]], self.high[self.first[owned]], owned, 2))
        again = owned[self.count[owned] > 1]
        order = np.argsort(self.kind, kind="stable")
        second = order[np.searchsorted(self.kind[order], again) + 1]
        second = np.where(second == self.first[again], order[np.searchsorted(self.kind[order], again)], second)
        rows.append((own[again], self.low[second], self.high[second], again, 2))
        rest = kinds[twice & ((code & OWNER) == 0)]
        rows.append((own[rest], self.low[self.first[rest]], self.high[self.first[rest]], rest, 4))
        for some, what in ((~twice & ((code & COMPANY) > 0), 1), (twice & ((code & COMPANY) > 0) & ((code & FIRST) > 0), 3)):
            plain = kinds[some & ((code & SPLIT) == 0)]
            rows.append((self.anchor[self.first[plain]], self.low[self.first[plain]], self.high[self.first[plain]], plain, what))
            hot = kinds[some & ((code & SPLIT) > 0)]
            rows += [(*r, what) for r in self._split_stretches(hot)]
        group, begin, end, kind = (np.concatenate([r[i] for r in rows]) for i in range(4))
        return group, begin, end, kind, np.concatenate([np.full(len(r[0]), r[4], np.uint8) for r in rows])

    def _split_stretches(self, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The windows of hot regions by how many bytes they have on both sides of the minimum, in powers of two."""
        gram = self.window // 2
        rest = self.window - gram
        least = lambda x: 1 << (x.bit_length() - 1) if x else 0
        sides = [(least(left), least(rest - left)) for left in range(rest + 1)]
        cut = [i for i in range(rest + 1) if not i or sides[i] != sides[i - 1]] + [rest + 1]
        r = self.first[kinds]
        order = np.argsort(self.at[r], kind="stable")
        r, kinds = r[order], kinds[order]
        for few, more in zip(cut[:-1], cut[1:]):
            left, right = sides[few]
            begin, end = np.maximum(self.low[r], self.at[r] - more + 1), np.minimum(self.high[r], self.at[r] - few)
            some = np.flatnonzero(begin <= end)
            for part in self.parts(some, self.at[r[some]]):
                at = self.at[r[part]]
                low = at[0] - left
                sums = prefix_sums(self.data[low : at[-1] + gram + right].astype(U) + U(1))
                group = mix(spans(sums, at - left - low, at + gram + right - low) + U(few + 1))
                yield group, begin[part], end[part], kinds[part]


def _groups(group: np.ndarray, some: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Some stretches in order of group, about SEGMENT bytes of whole groups at a time."""
    some = some[np.argsort(group[some], kind="stable")]
    if len(some):
        new = np.flatnonzero(np.append(True, group[some][1:] != group[some][:-1]))
        turn = (np.cumsum(size[some]) - size[some])[new] // SEGMENT
        yield from np.split(some, new[1:][turn[1:] != turn[:-1]])


def _bytes(column: pa.ChunkedArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these rows one after the other, and where each begins (one more at the end)."""
    own = column.take(pa.array(rows)).combine_chunks()
    _, offsets, data = own.buffers()
    off = np.frombuffer(offsets, np.int64, len(own) + 1, own.offset * 8)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def remove_repeated_bytes(docs: DataFrame, length: int = 200, keep_first: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, bytes removed, the maximal runs removed, and the bytes kept."""
    X.tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = X.buckets(docs)
    chunked = X.chunks(docs, ["doc_id", "text"], size=1 << 20)

    def regions(table: pa.Table, _):
        x = Regions(table, length)
        for b, s in x.split(n):
            yield b, np.packbits(x.count[s] > 1).tobytes() + x.region[x.first[s]].tobytes() + pack48(x.anchor[x.first[s]] >> U(16))

    def companies(rows):
        keys, kinds, again = [], [], []
        for _, p in rows:
            k = len(p) * 8 // 113
            while -(-k // 8) + 14 * k < len(p):
                k += 1
            again.append(np.unpackbits(np.frombuffer(p, np.uint8, -(-k // 8)), count=k).astype(bool))
            kinds.append(np.frombuffer(p[-(-k // 8) : len(p) - 6 * k], "<u8"))
            keys.append(unpack48(p[len(p) - 6 * k :]))
        every, part = X.joined_keys(keys)
        kind, more = np.concatenate(kinds), np.concatenate(again)
        order = np.lexsort((part, kind, every))
        a, r = every[order], kind[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        first = new_a | np.concatenate(([True], r[1:] != r[:-1]))
        new = np.flatnonzero(first)
        size = np.diff(np.append(new, len(a)))
        twice = (size > 1) | np.logical_or.reduceat(more[order], new)
        group = np.cumsum(new_a)[new] - 1
        kinds_of = np.bincount(group)[group]
        said = np.repeat(TWICE * twice + COMPANY * (kinds_of > 1) + SPLIT * (kinds_of > HOT), size).astype(np.uint8)
        said[first] |= FIRST | OWNER
        # the second chunk is an owner too, where the first has but one copy
        after = new[(size > 1) & ~more[order][new]] + 1
        said[after] |= OWNER
        code = np.empty(len(a), np.uint8)
        code[order] = said
        for i in range(len(rows)):
            yield code[_slice(part, i)].tobytes()

    def sent(x: Regions, got: dict[int, bytes]):
        """(the stretches of a chunk, by bucket: their numbers)."""
        code = x.codes({b: p for b, p in got.items() if b < X.NEXT}, n)
        found = x.stretches(code)
        return found, list(X.by_bucket(found[0], n))

    def ends(table: pa.Table, got):
        x = Regions(table, length)
        (group, begin, end, _, what), by = sent(x, got)
        raw = x.data.tobytes()
        for b, s in by:
            own = [raw[i : j + length] if w != 4 else None for i, j, w in zip(begin[s].tolist(), end[s].tolist(), what[s].tolist())]
            yield b, X.pack(pa.table({"group": group[s], "what": what[s], "bytes": pa.array(own, pa.large_binary())}))

    def factors(rows):
        tables = [X.unpack(p) for _, p in rows]
        every = pa.concat_tables(tables)
        group, what = every["group"].to_numpy(), every["what"].to_numpy()
        size = pc.fill_null(pc.binary_length(every["bytes"]), 0).to_numpy().astype(np.int64)
        bits = np.where(what == 1, size - length + 1, what != 3)  # of the answer
        at = np.cumsum(bits) - bits
        good = np.zeros(bits.sum(), bool)
        # copies of whole regions
        for some in _groups(group, np.flatnonzero(what == 2), size):
            data, off = _bytes(every["bytes"], some)
            good[at[some]] = whole(data, off[:-1], size[some])
        owned = np.flatnonzero(what == 2)
        owned = owned[np.argsort(group[owned], kind="stable")]
        asked = np.flatnonzero(what == 4)
        if len(owned) and len(asked):
            held = np.minimum(np.searchsorted(group[owned], group[asked]), len(owned) - 1)
            good[at[asked]] = (group[owned[held]] == group[asked]) & good[at[owned[held]]]
        # windows of the others
        for some in _groups(group, np.flatnonzero((what == 1) | (what == 3)), size):
            data, off = _bytes(every["bytes"], some)
            count = size[some] - length + 1
            begin = np.repeat(off[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
            earlier, later = reaching(data, begin, length)
            mine = np.repeat(what[some] == 1, count)
            to = np.repeat(at[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            good[to[mine]] = (earlier | later)[mine]
        low = 0
        for t in tables:
            high = low + t.num_rows
            first, last = (at[low], at[high - 1] + bits[high - 1]) if t.num_rows else (0, 0)
            yield np.packbits(good[first:last]).tobytes()
            low = high

    def repeats(x: Regions, got: dict[int, bytes]) -> np.ndarray:
        """Where all windows of a chunk begin that a factor says are repeated."""
        (_, begin, end, kind, what), by = sent(x, got)
        verified, out = np.zeros(len(x.first), bool), []
        for b, s in by:
            bits = np.where(what[s] == 1, end[s] - begin[s] + 1, what[s] != 3)
            if not bits.any():
                continue  # only to be met by others' windows, so there is no answer
            at = np.cumsum(bits) - bits
            good = np.unpackbits(np.frombuffer(got[b + X.NEXT], np.uint8), count=bits.sum()).astype(bool)
            one = (what[s] == 2) | (what[s] == 4)
            verified[kind[s[one]]] |= good[at[one]]
            some = what[s] == 1
            count = bits[some]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((np.repeat(begin[s[some]], count) + inside)[good[np.repeat(at[some], count) + inside]])
        out.append(x.starts(np.flatnonzero(verified[x.kind])))
        return np.sort(np.concatenate(out))

    def gone(table: pa.Table, got) -> pa.Table:
        x = Regions(table, length)
        return _result(table, x.data, x.off, [repeats(x, got)], length)

    first = X.answered(X.asked(chunked, regions, n), companies)
    second = X.answered(X.asked(X.rejoined(chunked, first), ends, n), factors, X.NEXT)
    if not keep_first:
        return X.finished(X.rejoined(chunked, first, second), gone, SCHEMA)

    def all_repeats(x: Regions, got: dict[int, bytes], ids: np.ndarray):
        """begin, key, second and id of all repeated windows, by key, then id and place."""
        found = list(x.keys(repeats(x, got)))
        begin, keys, second = (np.concatenate(y) for y in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, "<u4"))
        own = ids[np.searchsorted(x.off, begin, "right") - 1]
        order = np.lexsort((begin, own, second, keys))
        begin, keys, second, own = begin[order], keys[order], second[order], own[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])))[: len(keys)]
        return begin, keys, second, own, new

    def candidates(table: pa.Table, got):
        """All windows that are repeated, once a chunk, with the smallest id."""
        _, keys, second, ids, new = all_repeats(Regions(table, length), got, _order(table))
        keys, second, ids = keys[new], second[new], ids[new]
        for b, s in X.by_bucket(keys, n):
            yield b, second[s].tobytes() + ids[s].tobytes() + keys[s].tobytes()

    def later_ones(rows):
        seconds = [np.frombuffer(p, "<u4", len(p) // 20) for _, p in rows]
        pairs = [np.frombuffer(p, np.int64, -1, len(p) // 5).reshape(2, -1) for _, p in rows]
        whole, part = X.joined_keys([p[1].view(U) for p in pairs])
        second = np.concatenate(seconds)
        order = np.lexsort((part, np.concatenate([p[0] for p in pairs]), second, whole))
        late = np.zeros(len(whole), bool)
        late[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (second[order][1:] == second[order][:-1])
        for i, p in enumerate(pairs):
            own = late[_slice(part, i)]
            yield seconds[i][own].tobytes() + p[1][own].tobytes()

    def gone_later(table: pa.Table, got) -> pa.Table:
        x = Regions(table, length)
        begin, keys, second, _, new = all_repeats(x, got, _order(table))
        drop = ~new | isin_pairs(keys, second, [p for b, p in got.items() if b >= 2 * X.NEXT])
        return _result(table, x.data, x.off, [begin[drop]], length)

    third = X.answered(X.asked(X.rejoined(chunked, first, second), candidates, n), later_ones, 2 * X.NEXT)
    return X.finished(X.rejoined(chunked, first, second, third), gone_later, SCHEMA)


def _result(table: pa.Table, data: np.ndarray, off: np.ndarray, begins: list[np.ndarray], length: int) -> pa.Table:
    step = np.zeros(len(data) + 1, np.int32)
    for begin in begins:
        np.add.at(step, begin, 1)
        np.add.at(step, begin + length, -1)
    drop = np.cumsum(step[:-1], dtype=np.int32) > 0
    del step
    text_starts = off[:-1][off[:-1] < off[1:]]
    edge = np.concatenate(([True], drop[1:] != drop[:-1]))[: len(drop)]
    edge[text_starts] = True
    low = np.flatnonzero(edge)
    high = np.append(low[1:], len(drop))[: len(low)]
    low, high = low[drop[low]], high[drop[low]]
    at = np.searchsorted(low, off)
    raw, kept, runs = data.tobytes(), [], []
    for d in range(len(off) - 1):
        own, last, out = [], int(off[d]), []
        for i in range(at[d], at[d + 1]):
            out.append(raw[last : low[i]])
            own.append({"start": int(low[i] - off[d]), "end": int(high[i] - off[d])})
            last = int(high[i])
        out.append(raw[last : off[d + 1]])
        kept.append(b"".join(out))
        runs.append(own)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_bytes": np.diff(off), "n_removed": per_text(drop, off).astype(np.int64), "n_spans": np.diff(at).astype(np.int64), "spans": pa.array(runs, kind), "kept": pa.array(kept, pa.binary())})
