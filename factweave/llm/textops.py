"""Array kernels over Arrow string columns: words, 64-bit span hashes, sliding windows.

A column of texts is handled as one byte array with offsets, so a chunk of
documents costs a fixed number of numpy calls.  Null texts count as empty.
Two spans are taken as equal when their 64-bit hashes are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
# freed buffers go back to the system at once; a Python worker's memory counts
pa.set_memory_pool(pa.system_memory_pool())


def _bytes_but(*ranges: tuple[int, int]) -> np.ndarray:
    keep = np.ones(256, bool)
    for low, high in ranges:
        keep[low : high + 1] = False
    return keep


#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = _bytes_but((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _bytes_but((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least; very long ones are not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(1 << 16, 1 << (n - 1).bit_length())
    made = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, U)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U))
    if size <= 1 << 23:
        _powers = (made[0], made[1])
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def mix1(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], U))[0])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], from their prefix_sums."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def sliding(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U)
    _, down = powers(len(sums))
    return mix((sums[k:] - sums[:n]) * down[:n])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of each text's first word (one more at the end)."""
    inside = kind[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(prefix_sums(data.astype(U) + U(1)), start, end)


def hashed_words(column, kind: np.ndarray, lower: bool, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's first (one more at the end); about block bytes at a time."""
    data, off = flat(column)
    out, count, low, n = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0, len(off) - 1
    while low < n:
        high = min(max(int(np.searchsorted(off, off[low] + block)), low + 1), n)
        part = data[off[low] : off[high]]
        if lower:
            part = LOWER[part]
        start, end, first = words(part, off[low : high + 1] - off[low], kind)
        out.append(word_hashes(part, start, end))
        count.append(np.diff(first))
        low = high
    return np.concatenate(out), np.cumsum(np.concatenate(count))


def owner(first: np.ndarray) -> np.ndarray:
    """Of each item, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k items within one text, and where each run begins."""
    runs = sliding(prefix_sums(hashes), k)
    at = np.flatnonzero(np.arange(len(runs)) + k <= np.repeat(first[1:], np.diff(first))[: len(runs)])
    return runs[at], at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n items, those in a run of k that begins in at."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return np.cumsum(step[:-1]) > 0


def isin_sorted(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    at = np.searchsorted(held, x)
    return held[np.minimum(at, len(held) - 1)] == x


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def unique_per_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, in order, and where each text's begin."""
    n = len(first) - 1
    if not len(hashes):
        return hashes, np.zeros(n + 1, np.int64)
    order = np.argsort(hashes)
    text = owner(first)[order].astype(np.uint16 if n < 1 << 16 else np.int64)
    by = np.argsort(text, kind="stable")
    hashes, text = hashes[order][by], text[by]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(n + 1))


def pieces(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch of about so many bytes of text, a row at least."""
    text = batch.column(batch.schema.get_field_index(column))
    if not len(text):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    low = 0
    while low < len(size):
        high = int(np.searchsorted(size, (size[low - 1] if low else 0) + most)) + 1
        high = min(max(high, low + 1), len(size))
        yield batch.slice(low, high - low)
        low = high
