"""Operator 11, benchmark decontamination: Wu-Manber search for all windows of the test items in all documents.

The windows (``width`` consecutive words of an item; an item of fewer words is one window) are the patterns, words are
the symbols.  Patterns of one length form a class.  A table by the hash of a block of two words says how far a search
may step from a position whose last words are that block: where it says 0, the bucket of the block holds the patterns
that end with it, of which those with the hash of the words that stand there are compared word by word, byte by byte.
A search runs in many lanes of a chunk of text at once.

Patterns lie in blocks of bounded size, each broadcast for a pass over the documents, so that a set of test items of any
size can be searched for; a small one is one block.

Defined results: a null or empty text has no words and no hits; each row of the documents is searched by itself; rows
of items with one id are one item, items without an id hit words but are not named; an empty table of items hits
nothing; other columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch
from .license_scan import SEPARATOR

#: Consecutive words that make a window.
WIDTH = 10
#: Bytes of pattern text in one block, about.
BLOCK_BYTES = 8 << 20
#: Positions that one lane of a search goes through.
LANE = 64
_compiled: dict[str, list[Patterns]] = {}


def _block_hash(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return K.mix(before * K.BASE2 + last)


class Patterns:
    """Wu-Manber tables of patterns of one length: rows of ``hashes`` are their words, ``number`` their numbers."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, number: np.ndarray):
        n, self.width = hashes.shape
        self.data, self.number = data, number
        self.block = min(2, self.width)
        self.bits = max(12, int(8 * n * self.width).bit_length())
        self.shift = np.full(1 << self.bits, self.width - self.block + 1, np.uint16)
        for last in range(self.block - 1, self.width):
            np.minimum.at(self.shift, self.slot(hashes[:, last - self.block + 1], hashes[:, last]), self.width - 1 - last)
        key = self.key(self.slot(hashes[:, -self.block], hashes[:, -1]), self.whole(hashes))
        order = np.argsort(key, kind="stable")
        self.keys, self.number = key[order], number[order]
        self.start, self.end = start[order], end[order]

    def slot(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Cell of a block of words; with blocks of one word both are that word."""
        return (_block_hash(before, last) >> K.U(64 - self.bits)).astype(np.int64)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(hashes), np.uint64)
        for i in range(self.width):
            h = K.mix(h * K.BASE + hashes[:, i])
        return h

    def key(self, slot: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Patterns of a bucket are neighbours, by hash."""
        return (slot.astype(np.uint64) << K.U(64 - self.bits)) | (whole >> K.U(self.bits))

    def search(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern number) of every occurrence in the words of a chunk; none crosses a row's border."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        room = np.diff(borders) - self.width + 1
        lanes = np.maximum(0, -(-room // LANE))
        row = np.repeat(np.arange(len(room)), lanes)
        if not len(row):
            return none
        turn = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = borders[row] + self.width - 1 + turn * LANE
        stop = np.minimum(at + LANE, borders[row + 1])
        found = []
        while len(at):
            slot = self.slot(values[at - self.block + 1], values[at])
            step = self.shift[slot].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append((at[zero], slot[zero]))
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return none
        last, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        first = last - self.width + 1
        key = self.key(slot, self.whole(values[first[:, None] + np.arange(self.width)]))
        low = np.searchsorted(self.keys, key)
        many = np.searchsorted(self.keys, key, "right") - low
        first, low = np.repeat(first, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        same = self.equal(data, start, end, first, low)
        return first[same], self.number[low[same]]

    def equal(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Are the words from ``first`` those of the pattern ``at``, byte for byte?"""
        words = first[:, None] + np.arange(self.width)
        size = end[words] - start[words]
        same = (size == self.end[at] - self.start[at]).all(axis=1)
        pick = np.flatnonzero(same)
        flat = size[pick].ravel()
        if len(flat):
            inner = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
            ours = data[np.repeat(start[words[pick]].ravel(), flat) + inner]
            theirs = self.data[np.repeat(self.start[at[pick]].ravel(), flat) + inner]
            owner = np.repeat(np.repeat(np.arange(len(pick)), self.width), flat)
            same[pick[owner[ours != theirs]]] = False
        return same


def compile_patterns(texts: list[str], numbers: np.ndarray) -> list[Patterns]:
    """Tables for patterns given as words joined by one space, by their length in words."""
    parts = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    start, end, borders = K.words(data, offs, SEPARATOR)
    hashes = K.word_hashes(data, start, end)
    size = np.diff(borders)
    out = []
    for width in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == width)
        at = borders[own][:, None] + np.arange(width)
        out.append(Patterns(data, start[at], end[at], hashes[at], numbers[own]))
    return out


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id (a string), pattern: the distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for lo, hi, data, offs in K.text_chunks(batch):
                data = K.LOWER[data]
                start, end, borders = K.words(data, offs, SEPARATOR)
                text = data.tobytes()
                for r in range(hi - lo):
                    words = [text[s:e].decode() for s, e in zip(start[borders[r] : borders[r + 1]], end[borders[r] : borders[r + 1]], strict=True)]
                    found = list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))) if words else []
                    for i in range(0, len(found), 4096):
                        part = found[i : i + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + r].as_py()] * len(part), pa.string()), pa.array(part, pa.string())], names=["item_id", "pattern"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, pattern string").distinct()


def _search(docs: DataFrame, block: Broadcast, key: bool) -> DataFrame:
    """doc_id, n_words, spans (merged runs of hit words) and the numbers of the patterns of one block, for each row.

    With ``key``, also a digest of the text.
    """

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _compiled:
            _compiled.clear()  # a worker that goes on to another block or query
            _compiled[name] = compile_patterns(*block.value)
        for batch in batches:
            for lo, hi, data, offs in K.text_chunks(batch):
                data, n = K.LOWER[data], hi - lo
                start, end, borders = K.words(data, offs, SEPARATOR)
                values = K.word_hashes(data, start, end)
                found = [(p.width, *p.search(data, start, end, values, borders)) for p in _compiled[name]]
                first = np.concatenate([np.empty(0, np.int64), *[f for _, f, _ in found]])
                last = np.concatenate([np.empty(0, np.int64), *[f + w for w, f, _ in found]])
                number = np.concatenate([np.empty(0, np.int64), *[p for _, _, p in found]])
                row = np.searchsorted(borders, first, "right") - 1
                pairs = np.unique(np.column_stack([row, number]), axis=0)
                owner, start, end = K.merge_spans(row, first, last)
                start, end = start - borders[owner], end - borders[owner]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["first", "last"]))
                windows = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs[:, 1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, n) for c in keys], pa.array(np.diff(borders), pa.int64()), spans, windows], names=[*keys, "n_words", "spans", "windows"])

    text = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text)
    keys = [c for c in rows.columns if c != "text"]
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", n_words long, spans array<struct<first:long,last:long>>, windows array<long>")


def _merged(rows: DataFrame, passes: int) -> DataFrame:
    """One row for what ``passes`` searches found in a text; rows of one id and text are found alike, and stay as many."""
    # spans of a text are merged in order of their start; a row holds no more than the text has
    flat = F.array_sort(F.flatten(F.collect_list("spans")))
    join = lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(done, F.array(s)))
    spans = F.aggregate(flat, F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), join)
    found = rows.groupBy("doc_id", "h1", "h2").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("windows"))).alias("windows"), (F.count(F.lit(1)) / passes).cast("int").alias("_copies"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("doc_id", "n_words", "spans", "windows")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, spans, items.

    ``spans``: maximal runs of words under any occurrence of a window, as first word and the one after the last;
    ``items``: ids of the items whose windows occur, sorted as strings.
    """
    spark = docs.sparkSession
    windows = scratch(item_windows(items, width), "windows")
    texts = windows.select("pattern").distinct()
    size = texts.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("pattern"))
    patterns = scratch(texts.select("block", (F.col("block") * (1 << 32) + place).alias("window"), "pattern"), "patterns")
    passes = []
    for b in range(blocks):
        own = patterns.where(F.col("block") == b).select("window", "pattern").toPandas()  # about block_bytes
        block = spark.sparkContext.broadcast((own["pattern"].tolist(), own["window"].to_numpy(np.int64)))
        passes.append(scratch(_search(docs, block, blocks > 1), "found"))
        block.unpersist()
    rows = passes[0]
    for other in passes[1:]:
        rows = rows.unionByName(other)
    rows = rows if blocks == 1 else scratch(_merged(rows, blocks), "found")
    # texts with the same windows share a list of items; a list is known by 128 bits
    digest = [F.xxhash64("windows").alias("w1"), F.xxhash64(F.lit(1), "windows").alias("w2")]
    rows = rows.withColumns({"w1": digest[0], "w2": digest[1]})
    sets = rows.where(F.size("windows") > 0).groupBy("w1", "w2").agg(F.first("windows").alias("windows"))
    by_window = patterns.join(windows, "pattern").where(F.col("item_id").isNotNull()).select("window", "item_id")
    named = sets.select("w1", "w2", F.explode("windows").alias("window")).join(by_window, "window").groupBy("w1", "w2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return rows.join(named, ["w1", "w2"], "left").select("doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM pattern),
win AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k)),
hit AS (SELECT r, win.k, i, item_id FROM win JOIN pattern USING (k, s)),
word AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, k)) AS j FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
