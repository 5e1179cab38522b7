"""Operator 10, substring dedup by seed and extend.

Documents are joined on winnowed anchors (seeds of ``SEED`` words, at least one in every window of ``window``
words).  All places of a seed extend together, word by word and by the words themselves: to the right and to
the left, places stay in one class as long as their next words are equal.  Two places whose matches to both sides
make up a window or more hold a repeat; it is taken from all but the first place, and the windows of neighbouring
seeds merge into maximal repeats.  Segments that are equal as a whole are folded before, by 128-bit digest.

A seed with very many different surroundings gives way to longer seeds that hold it (see ``repeats``): first those of
``window - PIECE + 1`` words, which are extended in the same way, and where even those are as frequent, whole windows.

Defined results: null, empty or short texts lose nothing; a null doc_id is before all others; rows with
equal doc_id pool their removed spans; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R

#: Words of a seed: long enough that chance meetings are few, short enough to leave few anchors.
SEED = 9
#: Windows of a piece of a crowded seed's segment.
PIECE = 4


def single_spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a chunk, each with one space after it, and where each begins; the end is one border more."""
    at = np.append(0, np.cumsum(end - start + 1))
    out = np.full(at[-1], 0x20, np.uint8)
    size = end - start
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + within] = data[np.repeat(start, size) + within]
    return out.tobytes(), at


def word_ids(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of single-spaced segments, equal for equal words only, and the segments' borders in words."""
    segments = segments.cast(pa.large_binary())
    _, offs, data = segments.buffers()
    offs = np.frombuffer(offs, np.int64, len(segments) + 1, segments.offset * 8)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    start, end, borders = K.words(data, offs - offs[0])
    size = end - start
    packed = data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), borders


def refined(cls: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of equal (class, word); a place without a word (-1) stays alone from there on."""
    pair = (cls << np.int64(32)) | np.where(word < 0, 0, word + 1)
    out = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    ended = np.flatnonzero(word < 0)
    out[ended] = len(cls) + ended
    return out


def extensions(key: np.ndarray, seed: np.ndarray, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, k: int, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Classes of places by how far they match: left[i] by i words before the seed, right[i] by i words after it.

    A place is a seed of ``k`` words at ``seed`` in ``ids``, within the words [lower, upper) of its segment.
    """
    def word(i: np.ndarray) -> np.ndarray:
        inside = (i >= lower) & (i < upper)
        return np.where(inside, ids[np.clip(i, 0, max(len(ids) - 1, 0))], -1)

    same = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for i in range(k):
        same = refined(same, word(seed + i))
    left, right = [same], [same]
    for i in range(most):
        left.append(refined(left[-1], word(seed - 1 - i)))
        right.append(refined(right[-1], word(seed + k + i)))
    return left, right


def shown(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    start, end, borders = K.words(data, offs)
    return *single_spaced(data, start, end), borders


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc, starts, ends: word spans to remove from each document that has any."""

    def find(group: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of some whole groups, extended to both sides: the windows that stand at an earlier place, too."""
        hashes, doc, start, n, at = (group.column(c).to_numpy() for c in ("hash", "doc", "start", "n", "at"))
        ids, borders = word_ids(group.column("segment").combine_chunks())
        left, right = extensions(hashes, borders[:-1] + at, borders[:-1], borders[1:], ids, k, window - k)
        found = []
        for o in range(window - k + 1):  # windows with o words before the seed
            row = np.flatnonzero((at >= o) & (at - o < n))
            cls = (left[o][row] << np.int64(32)) | right[window - k - o][row]
            d, place = doc[row], start[row] + at[row] - o
            order = np.lexsort((place, d, cls))
            cls, d, place = cls[order], d[order], place[order]
            head = R.distinct(cls)
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            again = (d != d[first]) | (place != place[first])
            found.append((d[again], place[again]))
        d, s = (np.concatenate(v) for v in zip(*found, strict=True))
        return d, s, s + window

    return R.repeated_spans(docs, R.word_units, shown, find, min(SEED, window), window, (PIECE, 1), both=False)


def kept_words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """For each row: words, removed words, and the kept words joined by one space."""
    row, starts, ends = R.list_columns(batch)
    for lo, hi, data, offs in K.text_chunks(batch):
        start, end, borders = K.words(data, offs)
        raw = data.tobytes()
        size = np.diff(borders)
        a, b = np.searchsorted(row, [lo, hi])
        r = row[a:b] - lo
        gone = K.cover(borders[r] + np.minimum(starts[a:b], size[r]), borders[r] + np.minimum(ends[a:b], size[r]), len(start))
        s, e = start.tolist(), end.tolist()
        lost = np.diff(np.append(0, np.cumsum(gone))[borders]).tolist()
        for i, (x, y) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
            text = raw[offs[i] : offs[i + 1]]
            if lost[i]:
                keep = (np.flatnonzero(~gone[x:y]) + x).tolist()
                yield y - x, lost[i], b" ".join([raw[s[j] : e[j]] for j in keep])
            else:
                yield y - x, 0, b" ".join(text.split())


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Every document with n_words, n_removed and kept_text (kept words joined by one space)."""
    joined = R.attach(docs.select("doc_id", "text"), repeated_spans(docs, window))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                n, lost, kept = zip(*kept_words(part), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return joined.mapInArrow(K.released(keep), "doc_id long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with repeated passages taken out of their texts; columns stay, n_chars is counted anew.

    A text that loses nothing stays as it is, one that loses words is its kept words joined by one space, and a
    document that loses all its words goes.
    """
    names, joined = docs.columns, R.attach(docs, repeated_spans(docs, window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                columns = {c: part.column(c) for c in names}
                texts, chars, stay = part.column("text").to_pylist(), columns["n_chars"].to_pylist() if "n_chars" in names else None, []
                for i, (n, lost, kept) in enumerate(kept_words(part)):
                    stay.append(lost == 0 or lost < n)
                    if lost:
                        texts[i] = kept.decode()
                        if chars is not None:
                            chars[i] = len(texts[i])
                columns["text"] = pa.array(texts, columns["text"].type)
                if chars is not None:
                    columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
                yield pa.RecordBatch.from_pydict(columns).filter(pa.array(stay))

    return joined.mapInArrow(K.released(keep), docs.schema)


def op10(docs: DataFrame, window: int = 20) -> DataFrame:
    out = substring_dedup(docs, window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(0, 20)) AS j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
