"""Vectorised text kernels over Arrow buffers.  They run inside tasks, one bounded chunk at a time.

Texts are handled as UTF-8 bytes: ``data`` is the bytes of a chunk of rows, ``offs`` the
row borders in it.  Words are runs of bytes that are not ASCII blanks, so a row's words are the same
as on code points.  Hashes are 64-bit: a random-table polynomial over bytes, then a finaliser.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240917)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, BASE2 = U(0x9E6D62D06F6A9A9D), U(0xD1342543DE82EF95)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer row makes a chunk of its own.
CHUNK = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(CHUNK + 8, n)
        inverse = U(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= CHUNK + 8:
            _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end] for each pair, wherever it stands; lengths are mixed in."""
    x = (pre[end] - pre[start]) * powers(base, len(pre))[1][start]
    return mix(x ^ ((end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def grams(values: np.ndarray, k: int, base: np.uint64 = BASE2) -> np.ndarray:
    """Hash of every k consecutive values; borders of rows are not respected here."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    pre = prefix(values, base)
    return mix((pre[k:] - pre[:-k]) * powers(base, n)[1][:n])


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, borders) of bounded chunks of a batch; null is empty."""
    col = batch.column(column).cast(pa.large_binary() if pa.types.is_binary(batch.column(column).type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of set flags; a run ends at its row's border."""
    n = len(flags)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, borders of rows counted in words) of the words of a chunk."""
    start, end = runs(~separator[data], offs)
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(BYTE_CODE[data], BASE), start, end, BASE)


def in_row(borders: np.ndarray, k: int, n: int) -> np.ndarray:
    """Flags of the first n - k + 1 positions: does a window of k from there stay in one row?"""
    ok = np.zeros(n + 1, np.int64)
    size = np.diff(borders)
    has = size >= k
    np.add.at(ok, borders[:-1][has], 1)
    np.add.at(ok, borders[1:][has] - k + 1, -1)
    return np.cumsum(ok)[: max(0, n - k + 1)] > 0


def row_of(borders: np.ndarray) -> np.ndarray:
    """Row number of every position."""
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders))


def leftmost_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest (of equal ones the first) of every w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = (values & U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while step * 2 <= w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < w:
        key = np.minimum(key[:n], key[w - step : w - step + n])
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def anchors(values: np.ndarray, borders: np.ndarray, k: int, length: int):
    """Winnowed segments of a chunk.

    Every window of ``length`` values has one anchor: its smallest k-gram hash, leftmost of equal ones.
    Consecutive windows with one anchor form a segment.  Equal windows have equal anchors at equal
    offsets, so they meet under one anchor hash.  Returns first window, window count, anchor position,
    anchor hash, and a digest of all values the segment's windows hold.
    """
    gram = grams(values, k)
    at = leftmost_minima(gram, length - k + 1)
    ok = np.flatnonzero(in_row(borders, length, len(values))) if len(at) else np.empty(0, np.int64)
    if not len(ok):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = at[ok]
    new = np.empty(len(ok), bool)
    new[0] = True
    new[1:] = (np.diff(at) != 0) | (np.diff(ok) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(ok)))
    first, pos = ok[head], at[head]
    return first, count, pos, gram[pos], span_hash(prefix(values, BASE), first, first + count + length - 1, BASE)


def cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions under any of the spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.minimum(start, n), 1)
    np.add.at(d, np.minimum(end, n), -1)
    return np.cumsum(d[:n]) > 0


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each key, as maximal disjoint spans in order; touching spans are joined."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    fresh = np.empty(len(key), bool)
    fresh[0] = True
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    width = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * width) - group * width
    head = fresh.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1]


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, after which its worker gives freed memory back: workers outlive tasks and stages."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return whole
