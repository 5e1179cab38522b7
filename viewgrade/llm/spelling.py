"""Operator 13, spelling variant grouping: pairless wildcard groups.

Words (maximal runs of letters) are counted in the tasks that read them.  Two words are near if they differ by exactly
one inserted, deleted or replaced code point.  No pair is formed: words that agree but for one code point meet in the
group of (position, prefix, suffix), which keeps its size and its two largest words, enough to tell each member how many
others there are and which of them is the largest.  For insertions and deletions, each word less one code point is looked
up in the vocabulary; what is found is summed up for the longer and for the shorter word.  A group has one word for each
letter at most, so none is large, however frequent its words are.

Defined results: a null or empty text has no words; a null doc_id is written as nothing before the colon; rows that
repeat count again; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch

#: Code points that a word has at least, occurrences it has at least, and how much larger a form must be.
LEAST_SIZE, LEAST_COUNT, TIMES = 7, 2, 10
#: Where this divides the hash of a place, a code point is taken out.
EVERY = 31
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The first byte of U+00C0 to U+00FF, whose second one is any of 64.
LEAD = 0xC3
CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17


def letters(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes of letters."""
    wide = data == LEAD
    out = LETTER[data] | wide
    out[1:] |= wide[:-1]
    return out


def crc32(start: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of data[first:end] for each pair, carried on from the sums ``start``."""
    size = end - first
    order = np.argsort(-size, kind="stable")
    state, at = ~start[order], first[order]
    longer = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), "right")
    for i, n in enumerate(longer.tolist()):
        s = state[:n]
        state[:n] = CRC[(s ^ data[at[:n] + i]) & 0xFF] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def gathered(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as strings."""
    size = end - first
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at]))


def chunk_words(data: np.ndarray, offs: np.ndarray, ids: list, least: int, every: int) -> pa.Array:
    """The words of at least ``least`` code points of a chunk, after the deletions that the hashes ask for."""
    data = K.LOWER[data]
    first, end = K.runs(letters(data), offs)
    upto = np.concatenate([[0], np.cumsum(data == LEAD)])
    size = end - first - (upto[end] - upto[first])  # in code points
    keep = size >= least
    first, end, size = first[keep], end[keep], size[keep]
    row = np.searchsorted(offs, first, "right") - 1
    sums = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
    h = crc32(sums[row], data, first, end).astype(np.int64)
    cut = h % every == 0
    whole = gathered(data, first[~cut], end[~cut])
    text, short = data.tobytes(), []
    for f, e, at, n in zip(first[cut].tolist(), end[cut].tolist(), (h[cut] % size[cut]).tolist(), size[cut].tolist(), strict=True):
        if n > least:
            word = text[f:e].decode()
            short.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([whole, pa.array(short, pa.large_string())])


def word_counts(docs: DataFrame, least: int = LEAST_SIZE, every: int = EVERY) -> DataFrame:
    """word, n: how often each word of at least ``least`` code points occurs; tasks count before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = pa.array([], pa.large_string()), pa.array([], pa.int64())

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([word.cast(pa.string()), n], names=["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in K.text_chunks(batch):
                found = pc.value_counts(chunk_words(data, offs, ids[lo:hi], least, every))
                both = pa.table({"word": pa.concat_arrays([word, found.field(0)]), "n": pa.concat_arrays([n, found.field(1)])}).group_by("word", use_threads=False).aggregate([("n", "sum")])
                word, n = (pa.concat_arrays(both.column(c).chunks) if both.num_rows else x for c, x in (("word", word), ("n_sum", n)))
                if len(word) >= HELD:
                    yield out()
                    word, n = word[:0], n[:0]
        yield out()

    return docs.select(F.col("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranked(word: str, n: str) -> Column:
    """Sorts words: larger first, equal ones in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """word, near (number), best (ranked): of the words that differ by one replaced code point, for each position that has any."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    # the code point itself gives way to a space, which no word holds
    places = words.select(ranked("word", "n").alias("own"), at).withColumn("key", F.overlay("own.word", F.lit(" "), F.col("at"), F.lit(1))).drop("at")
    group = Window.partitionBy("key")
    first = F.min("own").over(group)
    placed = places.select("own", "key", (F.count(F.lit(1)).over(group) - 1).alias("near"), first.alias("first")).where("near > 0")
    second = F.min(F.when(F.col("own") != F.col("first"), F.col("own"))).over(group)
    return placed.withColumn("second", second).select("own.word", "near", F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """The same for words that differ by one code point that only one of them has; a row for each way a word is met."""
    at = F.sequence(F.lit(1), F.length("word"))
    shorter = F.array_distinct(F.transform(at, lambda i: F.overlay("word", F.lit(""), i, F.lit(1))))
    less = words.where(F.length("word") > LEAST_SIZE).select(ranked("word", "n").alias("long"), F.explode(shorter).alias("word"))
    met = less.join(words, "word").select("long", ranked("word", "n").alias("short"))
    both = F.inline(F.array(F.struct("long.word", F.col("short").alias("best")), F.struct("short.word", F.col("long").alias("best"))))
    return met.select(both).groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the way from a word over forms.  ``forms``: word, form.

    A form is ``TIMES`` times as frequent, so ways are short and have no circles; each pass doubles the steps taken.
    """
    found = scratch(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = found.select(F.col("word").alias("root"), F.col("root").alias("up"))
        found = scratch(found.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word with at least ``least`` occurrences."""
    words = scratch(word_counts(docs).where(F.col("n") >= least), "words")
    near = replaced(words).unionByName(indels(words)).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= times * F.col("n")
    found = scratch(found.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    way = roots(found.where("form IS NOT NULL"))
    return found.join(way, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op13(docs: DataFrame) -> DataFrame:
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS s(i))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run WHERE length(w) >= 7 GROUP BY doc_id, w),
hashed AS (SELECT w, m, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x) // 2 + 1), lambda j: (('0x' || x[2 * j - 1:2 * j])::UBIGINT))), lambda c, b: xor(t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)))::BIGINT AS h FROM each, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[(h % length(w)) + 2:] ELSE w END AS word, m FROM hashed),
word AS (SELECT word, sum(m)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
wild AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM place),
less AS (SELECT DISTINCT word, n, a || b AS d FROM wild),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM wild AS x JOIN wild AS y USING (i, a, b) WHERE x.word <> y.word
 UNION ALL SELECT less.word, word.word, word.n FROM less JOIN word ON d = word.word
 UNION ALL SELECT word.word, less.word, less.n FROM less JOIN word ON d = word.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)),
way AS (SELECT word, word AS last, 0 AS k FROM form UNION ALL SELECT way.word, form.form, k + 1 FROM way JOIN form ON form.word = way.last WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(last, k) AS root FROM way GROUP BY word) USING (word)
"""
