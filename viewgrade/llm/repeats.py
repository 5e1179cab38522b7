"""Segments under winnowed anchors: what suffix-array dedup and substring dedup share.

1. ``occurrences``: one Arrow pass cuts every document into segments (see ``kernels.anchors``).  A task keeps one
   row for each distinct segment of some tens of MB of text, so a passage that a third of all documents hold costs
   one row for those; the other copies become finished spans at once.
2. ``fold``: equal segments meet by anchor hash and digest, in sorted streams; one row of each stays.
3. ``wanted``: anchors with several different segments ask for their contents, to be compared in groups.  Those with
   more than ``BLOCK`` of them are cut into pieces of a few windows each, and what all windows of a piece hold is
   the piece's anchor: nearly as long as a window.  Pieces go through 2 and 3 again, at last window by window.
4. ``spans_by_document`` and ``attach`` bring the spans, merged, back to the documents.

Segments (at last, windows) that are equal as a whole are told by 128 bits: two polynomial digests modulo 2^64.
Rows that share a doc_id count as one document written twice: their spans are pooled.  A null doc_id is
an id of its own, before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import NULL_ID, join_bounded, scratch

ROWS = "kind int, hash long, digest long, doc long, start long, n int, at int"
ROWS_ARROW = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("digest", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
SEGMENTS = ROWS_ARROW.append(pa.field("segment", pa.binary()))
SPAN, SINGLE, SEVERAL = range(3)
#: Segments that a task of the first pass folds at once.
FOLD = 1 << 18
#: Segments that are compared at once, unless one group has more (about 1 MB).
GROUP_ROWS = 2048
#: Different segments that are compared in one group; those of an anchor with more are cut into pieces.
BLOCK = 64


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null as the smallest id) and text, whatever else the table holds."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")


def distinct(*columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the row before them."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_CODE[data], offs


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, borders = K.words(data, offs)
    return K.word_hashes(data, start, end), borders


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Finished spans, merged; dealt by document wherever they pass a shuffle."""
    doc, start, end = K.merge_spans(doc, start, end)
    none = np.zeros(len(doc), np.int64)
    return K.table({"kind": none + SPAN, "hash": K.mix(doc.astype(np.uint64)).view(np.int64), "digest": none, "doc": doc, "start": start, "n": end - start, "at": none}, ROWS_ARROW)


def first_of_each(x: dict[str, np.ndarray], length: int, both: bool) -> tuple[dict[str, np.ndarray], tuple]:
    """The first place of each (hash, digest) of rows in any order, and the spans (doc, start, end) that are settled."""
    order = np.lexsort((x["start"], x["doc"], x["digest"], x["hash"]))
    x = {c: v[order] for c, v in x.items()}
    head = distinct(x["hash"], x["digest"])
    group, at = np.cumsum(head) - 1, np.flatnonzero(head)
    moved = (x["doc"] != x["doc"][at][group]) | (x["start"] != x["start"][at][group])
    several = np.bincount(group, moved | (x["kind"] == SEVERAL), len(at)) > 0
    done = several[group] if both else moved
    spans = x["doc"][done], x["start"][done], (x["start"] + x["n"] + length - 1)[done]
    return {c: np.where(several, SEVERAL, SINGLE) if c == "kind" else v[at] for c, v in x.items()}, spans


class Folder:
    """Segments of a task, folded some ``FOLD`` rows at a time into batches of ``ROWS``."""

    def __init__(self, length: int, both: bool):
        self.length, self.both, self.parts, self.size = length, both, [], 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append({"kind": np.full(len(columns["doc"]), SINGLE, np.int32), **columns})
        self.size += len(columns["doc"])
        if self.size >= FOLD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            x = {c: np.concatenate([p[c] for p in self.parts]) for c in ROWS_ARROW.names}
            first, spans = first_of_each(x, self.length, self.both)
            yield span_rows(*spans)
            yield K.table(first, ROWS_ARROW)
        self.parts, self.size = [], 0


def occurrences(docs: DataFrame, units: Callable, k: int, length: int, both: bool) -> DataFrame:
    """Rows of ``ROWS``: segments (kinds SINGLE, SEVERAL) and finished spans (SPAN, n units long).

    ``both``: a repeat condemns all its occurrences; otherwise the first one, by doc and start, stays.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(length, both)
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, _, data, offs in K.text_chunks(batch):
                values, borders = units(data, offs)
                first, n, pos, hashes, digest = K.anchors(values, borders, k, length)
                row = np.searchsorted(borders, first, "right") - 1
                yield from folder.add(hash=hashes.view(np.int64), digest=digest.view(np.int64), doc=ids[lo + row], start=first - borders[row], n=n, at=pos - first)
        yield from folder.flush()

    return keyed(docs).mapInArrow(K.released(cut), ROWS)


def fold(rows: DataFrame, length: int, both: bool) -> DataFrame:
    """Rows of ``ROWS``: all settled spans, and the first place of each (hash, digest) (kind SINGLE or SEVERAL).

    The rows come sorted, so a task holds one batch and the first row of the group that is still open.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = batch.column("kind").to_numpy() == SPAN
            if done.any():
                yield batch.filter(pa.array(done))
            x = {c: batch.column(c).to_numpy()[~done] for c in ROWS_ARROW.names}
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            if not len(x["doc"]):
                continue
            first, spans = first_of_each(x, length, both)
            yield span_rows(*spans)
            held = {c: v[-1:] for c, v in first.items()}
            yield K.table({c: v[:-1] for c, v in first.items()}, ROWS_ARROW)
        if held is not None:
            yield K.table(held, ROWS_ARROW)

    return rows.repartition("hash", "digest").sortWithinPartitions("hash", "digest", "doc", "start").mapInArrow(K.released(meet), ROWS)


def wanted(folded: DataFrame) -> DataFrame:
    """doc, hash, crowded, start, n, at of each segment whose anchor has other segments."""
    single = folded.where(f"kind <> {SPAN}")
    several = scratch(single.groupBy("hash").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "anchors")
    met = join_bounded(single, several, "hash", "inner", 32)
    return met.select("doc", "hash", (F.col("different") > BLOCK).alias("crowded"), "start", "n", "at")


def pieces(values: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, length: int, width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Segments cut into pieces of at most ``width`` windows: number of the segment, and the pieces' columns.

    Pieces are cut by how far a window's anchor lies from its start, so equal windows come into like pieces.
    """
    least = at - n + 1
    count = at // width - least // width + 1
    every = np.repeat(np.arange(len(n)), count)
    low = (least[every] // width + np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)) * width
    high = np.minimum(low + width - 1, at[every])
    start = first[every] + at[every] - high
    size = high - np.maximum(low, least[every]) + 1
    core = first[every] + at[every] - low
    columns = {"hash": K.span_hash(K.prefix(values, K.BASE2), core, core + length - width + 1, K.BASE2), "digest": K.span_hash(K.prefix(values, K.BASE), start, start + size + length - 1, K.BASE)}
    return every, {**{c: x.view(np.int64) for c, x in columns.items()}, "start": start - first[every], "n": size, "at": high - low}


def contents(docs: DataFrame, asked: DataFrame, units: Callable, shown: Callable, length: int, width: int, both: bool) -> DataFrame:
    """``SEGMENTS``, sorted by hash: wanted segments with their contents, or, if crowded, their pieces without.

    ``shown(data, offs)``: bytes of a chunk, where each unit begins in them, and the rows' borders in units.
    """
    packed = asked.groupBy("doc").agg(F.collect_list(F.struct("hash", "crowded", "start", "n", "at")).alias("wanted"))
    # what is wanted grows with the corpus, so both sides are shuffled at every size
    joined = keyed(docs).join(packed.hint("merge"), "doc")

    def bare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in rows:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(len(x), pa.binary())], schema=SEGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(length, both)
        for batch in batches:
            ids, lists = batch.column("doc").to_numpy(), batch.column("wanted")
            for lo, hi, data, offs in K.text_chunks(batch):
                raw, at, borders = shown(data, offs)
                part = lists.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                flat = part.flatten()
                x = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("hash", "crowded", "start", "n", "at")}
                # another text under the same doc_id may be shorter
                ok = x["start"] + x["n"] + length - 1 <= np.diff(borders)[row]
                plain, some = np.flatnonzero(ok & ~x["crowded"]), np.flatnonzero(ok & x["crowded"])
                first = borders[row] + x["start"]
                segment = [raw[a:b] for a, b in zip(at[first[plain]].tolist(), at[(first + x["n"] + length - 1)[plain]].tolist(), strict=True)]
                none = np.zeros(len(plain), np.int64)
                yield K.table({**{c: x[c][plain] for c in ("hash", "start", "n", "at")}, "kind": none + SINGLE, "digest": none, "doc": ids[lo + row[plain]], "segment": segment}, SEGMENTS)
                if len(some):
                    which, found = pieces(units(data, offs)[0], first[some], x["n"][some], x["at"][some], length, width)
                    which = some[which]
                    yield from bare(folder.add(**{**found, "doc": ids[lo + row[which]], "start": x["start"][which] + found["start"]}))
        yield from bare(folder.flush())

    schema = f"{ROWS}, segment binary"
    return joined.mapInArrow(K.released(cut), schema).repartition("hash").sortWithinPartitions("hash")


def whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """A stream sorted by hash, cut at borders of hashes into tables of about ``size`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, len(batch), size):
            held.append(batch.slice(lo, size))
            if sum(map(len, held)) < size:
                continue
            joined = pa.Table.from_batches(held).combine_chunks()
            hashes = joined.column("hash").to_numpy()
            border = int(np.searchsorted(hashes, hashes[-1]))
            if border:
                yield joined.slice(0, border)
            held = joined.slice(border).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def repeated_spans(docs: DataFrame, units: Callable, shown: Callable, find: Callable, k: int, length: int, widths: tuple[int, ...], both: bool) -> DataFrame:
    """doc, starts, ends: spans of every document that repeat.

    ``find(table of SEGMENTS, k)``: the spans (doc, start, end) that some whole groups of segments settle; k units
    at ``at`` are what a group has in common.  ``widths``: windows of a piece, from pass to pass; the last is 1.
    """
    folded = scratch(fold(occurrences(docs, units, k, length, both), length, both), "folded")
    spans = folded.where(f"kind = {SPAN}")
    for size, width in zip((k, *[length - w + 1 for w in widths]), widths, strict=False):

        def compare(batches: Iterator[pa.RecordBatch], k: int = size) -> Iterator[pa.RecordBatch]:
            def segments() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    whole = batch.column("segment").is_valid()
                    rest.append(batch.filter(pc.invert(whole)).select(ROWS_ARROW.names))
                    yield batch.filter(whole)

            rest: list[pa.RecordBatch] = []
            for group in whole_groups(segments(), GROUP_ROWS):
                yield span_rows(*find(group, k))
                yield from rest
                rest.clear()
            yield from rest

        found = scratch(contents(docs, wanted(folded), units, shown, length, width, both).mapInArrow(K.released(compare), ROWS), "compared")
        spans = spans.unionByName(found.where(f"kind = {SPAN}"))
        parts = found.where(f"kind <> {SPAN}")
        if parts.isEmpty():
            break
        folded = scratch(fold(parts, length, both), "folded")
        spans = spans.unionByName(folded.where(f"kind = {SPAN}"))
    return spans_by_document(spans.select("doc", "start", "n"))


def spans_by_document(spans: DataFrame) -> DataFrame:
    """doc, starts, ends: the union of each document's spans as maximal runs, in order."""
    schema = pa.schema([("doc", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "start", "n")] for b in batches]
        if not parts:
            return
        doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, s, e = K.merge_spans(doc, start, start + n)
        if not len(key):
            return
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        offs = pa.array(np.append(at, len(key)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.ListArray.from_arrays(offs, pa.array(s)), pa.ListArray.from_arrays(offs, pa.array(e))], schema=schema)

    return scratch(spans.select("doc", "start", "n").repartition("doc").mapInArrow(K.released(merge), "doc long, starts array<long>, ends array<long>"), "spans")


def attach(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """All rows and columns of the documents, with __vg_starts and __vg_ends of the spans to remove (null: none)."""
    side = merged.select(F.col("doc").alias("__vg_doc"), F.col("starts").alias("__vg_starts"), F.col("ends").alias("__vg_ends"))
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(F.size("__vg_starts")), F.lit(0))).first()
    left = docs.withColumn("__vg_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return join_bounded(left, side, "__vg_doc", "left", 72 + 16 * size // max(rows, 1), rows).drop("__vg_doc")


def list_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every span of a batch made by ``attach``."""
    starts, ends = batch.column("__vg_starts"), batch.column("__vg_ends")
    size = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), starts.flatten().to_numpy(zero_copy_only=False), ends.flatten().to_numpy(zero_copy_only=False)
