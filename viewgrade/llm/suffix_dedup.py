"""Operator 1, suffix-array dedup: every byte under a 400-byte string that starts twice is removed.

Segments of documents meet by winnowed anchor.  Those that are alike as a whole are settled by 128-bit digest, without
comparing bytes; the different ones under one anchor are concatenated and get a suffix array by two-stage sorting:
suffixes smaller than their successors are sorted directly, the others are induced by scans over the buckets, and the
common prefixes of neighbours show the strings that start twice.  Segments of an anchor with very many different ones
are split by what surrounds it (see ``repeats``), and each part is sorted by itself.

Defined results: null or short texts lose nothing; rows with equal doc_id count as one document written
twice (their spans are pooled); kept bytes may end inside a character, so they stay binary; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R

SEED = 128
#: Windows of a piece of a crowded anchor's segment.
PIECE = 16


def next_nonzero(x: np.ndarray) -> np.ndarray:
    """For every position the first one from there on that isn't zero (the length if none)."""
    at = np.where(x != 0, np.arange(len(x)), len(x))
    return np.minimum.accumulate(at[::-1])[::-1]


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array, to ``depth`` symbols, of the flagged suffixes of ``text`` (uint8) and those they need.

    Equal prefixes of ``depth`` symbols stand together.  The end of the text is smaller than any symbol.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # before the end of the text
    rising = step[next_nonzero(step)] > 0
    # a falling suffix needs its successors up to the first rising one
    need = wanted.copy()
    falling = np.flatnonzero(wanted & ~rising)
    if len(falling):
        stop = next_nonzero(rising.astype(np.int8))[falling]
        need |= K.cover(falling, np.minimum(stop + 1, n), n)
    raw = text.tobytes()
    direct = np.flatnonzero(need & rising)
    direct = direct[np.argsort(text[direct], kind="stable")]
    border = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        rows = direct[border[c] : border[c + 1]].tolist()
        # first stage: the rising suffixes of the bucket, compared directly
        rows.sort(key=lambda i: raw[i : i + depth])
        bucket, level = [], np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(level):
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[(text[level] == c) & need[level]]
        bucket = np.concatenate([*bucket, np.array(rows, np.int64)])
        if not len(bucket):
            continue
        out.append(bucket)
        # second stage: a falling suffix follows its successor into the bucket of its own symbol
        before = bucket[bucket > 0] - 1
        before = before[need[before] & (text[before] > c)]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(symbol[order]) != 0))
            for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
                pending[symbol[order[a]]].append(before[order[a:b]])
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def neighbours_share(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Does each suffix (but the last) of the array share ``depth`` symbols with the next one?"""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), np.uint64)
    for i in range(8):
        word |= padded[i : i + len(text)].astype(np.uint64) << np.uint64(8 * i)
    p, q = order[:-1], order[1:]
    alive = np.flatnonzero(np.maximum(p, q) + depth <= len(text))
    common = np.zeros(len(p), bool)
    steps = [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])] if depth >= 8 else [0]
    for d in steps:
        x, y = word[p[alive] + d], word[q[alive] + d]
        alive = alive[x == y if depth >= 8 else (x ^ y) << np.uint64(64 - 8 * depth) == 0]
    common[alive] = True
    return common


def string_classes(segments: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Of each segment's first counts[i] positions, segment after segment: the class of the string that starts there."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    at = np.cumsum([0, *map(len, segments[:-1])])
    start = np.repeat(at - np.cumsum(np.append(0, counts[:-1])), counts) + np.arange(counts.sum())
    wanted = np.zeros(len(text), bool)
    wanted[start] = True
    order = two_stage(text, wanted, length)
    cls = np.zeros(len(text), np.int64)
    cls[order] = np.cumsum(np.append(True, ~neighbours_share(text, order, length))) - 1
    return cls[start]


def shown(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    return data.tobytes(), np.arange(len(data) + 1), offs


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc, starts, ends: byte spans to remove from each document that has any."""

    def find(group: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A suffix array for some whole groups: places of the strings that stand at two places or more."""
        doc, start, n = (group.column(c).to_numpy() for c in ("doc", "start", "n"))
        cls = string_classes(group.column("segment").to_pylist(), n, length)
        row = np.repeat(np.arange(len(n)), n)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        often = np.flatnonzero((np.bincount(cls) > 1)[cls])
        often = often[np.lexsort((place[often], doc[row[often]], cls[often]))]
        cls, d, s = cls[often], doc[row[often]], place[often]
        # places, not rows: a document may be there twice
        group_ = np.cumsum(R.distinct(cls)) - 1
        twice = (np.bincount(group_, R.distinct(cls, d, s)) > 1)[group_] if len(cls) else np.zeros(0, bool)
        return d[twice], s[twice], s[twice] + length

    return R.repeated_spans(docs, R.byte_units, shown, find, min(SEED, length), length, (PIECE, 1), both=True)


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """Every document with n_bytes, n_removed, n_spans and kept (binary: its remaining bytes)."""
    joined = R.attach(docs.select("doc_id", "text"), repeated_spans(docs, length))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                row, starts, ends = R.list_columns(part)
                spans: dict[int, list] = {}
                for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    spans.setdefault(r, []).append((s, e))
                kept, counts = [], []
                for i, text in enumerate(part.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()):
                    at, pieces, gone = 0, [], [(s, min(e, len(text))) for s, e in spans.get(i, ()) if s < len(text)]
                    for s, e in gone:
                        pieces.append(text[at:s])
                        at = e
                    kept.append(b"".join([*pieces, text[at:]]))
                    counts.append((len(text), len(text) - len(kept[-1]), len(gone)))
                n, lost, k = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1(docs: DataFrame, length: int = 400) -> DataFrame:
    """The digest columns, then the kept text (what a cut leaves of a character shows as U+FFFD)."""
    out = suffix_dedup(docs, length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
