"""Operator 12, hard-negative mining: bit-sliced integer products with score intervals.

Components become whole numbers.  A block of rows is cut into bit planes of its components, in two's complement; the
products of the anchors with the planes are added up from the sign downwards.  After each plane the planes still to come
can change a score by no more than an anchor's positive and negative components allow, so every pair has an interval.
Pairs whose interval can no longer qualify are dropped: for positives, below the anchor's fifth best so far; for
negatives, outside of what every positive of the anchor still admits, whose lower end rises to its third best so far.
Few pairs are left after the high planes; these go on one by one.

Anchors are a fixed part of the rows and meet all rows in blocks: as many anchors as ``ANCHOR_BYTES`` hold are broadcast
for a pass over the rows, which are never shuffled.  A task keeps the best few of each anchor, and the best of all tasks
are ranked by a window with a limit, whose groups are cut to the limit before the shuffle.

Defined results: rows without an id, a label or a whole vector of finite numbers take no part; "other" rows are those of
another vec_id; rows that repeat are rows of their own, and anchors that repeat have results of their own; vectors of
different lengths have no score; a score beyond 64 bits is an error, as in Spark's arithmetic; an empty table gives an empty
result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Positives of an anchor, and negatives of each of them.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
#: Bytes of the anchors' components in one pass, and the anchors and rows of a tile.
ANCHOR_BYTES, ANCHORS, ROWS = 16 << 20, 256, 2048
#: Share of a tile's pairs below which they go on one by one.
FEW = 1 / 16
_LEAST, _MOST = -(1 << 62), 1 << 62


def whole_vectors(rows: DataFrame, scale: int = 256, classes: int = 10, shifted: int = 7) -> DataFrame:
    """vec_id, label, v: rows that take part, with components floor(scale * x); every ``shifted``-th id has the next label."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shifted == 0, (label + 1) % classes).otherwise(label)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def planes_of(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, 0/1 plane) of whole numbers, the sign's first: v is the sum of weight * plane."""
    high = int(max(v.max(initial=0), ~v.min(initial=0))).bit_length()
    top = [(-(1 << high), (v < 0).astype(np.float64))]
    return top + [(1 << k, ((v >> k) & 1).astype(np.float64)) for k in range(high - 1, -1, -1)]


class Side:
    """Anchors of one length as a matrix, with what the planes to come can add or take."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.number, self.ids, self.labels, self.v = number, ids, labels, v
        self.exact = v.astype(np.float64)
        self.up, self.down = np.maximum(v, 0).sum(1), np.minimum(v, 0).sum(1)


def sliced(side: Side, own: np.ndarray, v: np.ndarray, planes: list[tuple[int, np.ndarray]], wanted, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that stay: ``wanted(anchor, low, high)`` says whether an interval may qualify.

    ``open_`` flags the pairs of the tile that take part at all.
    """
    a = side.exact[own]
    if len(own) and v.size and len(v[0]) * float(np.abs(a).max()) * float(np.abs(v.astype(np.float64)).max()) >= 2.0**62:
        raise ArithmeticError("a score does not fit into 64 bits")
    score = np.zeros((len(own), len(v)), np.int64)
    i = j = None
    for weight, plane in planes:
        rest = abs(weight) - 1  # the greatest sum of the weights below, and before the sign's plane nothing is known
        if i is None:
            score += weight * np.rint(a @ plane.T).astype(np.int64)
            low, high = score + rest * side.down[own][:, None], score + rest * side.up[own][:, None]
            open_ &= wanted(own[:, None], low, high)
            if np.count_nonzero(open_) <= FEW * open_.size:
                i, j = np.nonzero(open_)
                score = score[i, j]
        else:
            score += weight * np.rint(np.einsum("pd,pd->p", a[i], plane[j])).astype(np.int64)
            stay = wanted(own[i], score + rest * side.down[own[i]], score + rest * side.up[own[i]])
            i, j, score = i[stay], j[stay], score[stay]
        if i is not None and not len(i):
            break
    if i is None:
        i, j = np.nonzero(open_)
        score = score[i, j]
    return own[i], j, score


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group by falling score, then by id; in order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    head = np.searchsorted(g, g)
    return order[np.arange(len(g)) - head < most]


class Kept:
    """The best few of each group that a task has seen, and the score below which no other one is among them."""

    def __init__(self, groups: int, most: int):
        self.most, self.floor = most, np.full(groups, _LEAST)
        self.group = self.score = self.ids = np.empty(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids)))
        at = best_of(group, score, ids, self.most)
        self.group, self.score, self.ids = group[at], score[at], ids[at]
        last = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True))
        full = last[np.bincount(self.group, minlength=len(self.floor))[self.group[last]] == self.most]
        self.floor[self.group[full]] = self.score[full]


def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length in a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offs = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.offsets)
    offs, size = offs - offs[0], np.diff(np.asarray(column.offsets))
    out = []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out.append((at, flat[offs[at][:, None] + np.arange(d)]))
    return out


def sides_of(anchors: pa.Table) -> dict[int, Side]:
    number, ids, labels = (anchors.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
    return {v.shape[1]: Side(number[at], ids[at], labels[at], v) for at, v in vectors(anchors.column("v"))} if len(number) else {}


def _tiles(batch: pa.RecordBatch, sides: dict[int, Side]) -> Iterator[tuple[Side, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, ids, labels, vectors) of at most ROWS rows of one length."""
    ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
    for at, v in vectors(batch.column("v")):
        if (side := sides.get(v.shape[1])) is not None:
            for lo in range(0, len(at), ROWS):
                yield side, ids[at[lo : lo + ROWS]], labels[at[lo : lo + ROWS]], v[lo : lo + ROWS]


def _positives(rows: DataFrame, anchors: Broadcast) -> DataFrame:
    """anchor, other, score: the best rows of its label for each anchor, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(anchors.value)
        kept = {d: Kept(len(s.ids), POSITIVES) for d, s in sides.items()}
        for batch in batches:
            for side, ids, labels, v in _tiles(batch, sides):
                best = kept[v.shape[1]]
                for label in np.intersect1d(labels, side.labels).tolist():
                    here = np.flatnonzero(labels == label)
                    planes, mine = planes_of(v[here]), np.flatnonzero(side.labels == label)
                    for lo in range(0, len(mine), ANCHORS):
                        own = mine[lo : lo + ANCHORS]
                        i, j, score = sliced(side, own, v[here], planes, lambda a, low, high, f=best.floor: high >= f[a], side.ids[own][:, None] != ids[here][None, :])
                        best.add(i, score, ids[here][j])
        for d, best in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(sides[d].number[best.group], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.score, pa.int64())], names=["anchor", "other", "score"])

    return rows.mapInArrow(run, "anchor long, other long, score long")


def _negatives(rows: DataFrame, anchors: Broadcast, positives: Broadcast) -> DataFrame:
    """anchor, place, other, score: the best rows of other labels for each positive (by place) of each anchor, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(anchors.value)
        owner, score = positives.value.column("anchor").to_numpy(), positives.value.column("score").to_numpy()
        place = positives.value.column("place").to_numpy()
        state = {}
        for d, side in sides.items():
            low, high = np.full((len(side.ids), POSITIVES), _MOST), np.full((len(side.ids), POSITIVES), _LEAST)
            order = np.argsort(side.number)
            at = np.minimum(np.searchsorted(side.number[order], owner), len(order) - 1)
            mine = side.number[order[at]] == owner
            a, p = order[at[mine]], place[mine] - 1
            low[a, p], high[a, p] = -(-LOW * score[mine] // 100), HIGH * score[mine] // 100
            state[d] = (low, high, Kept(len(side.ids) * POSITIVES, NEGATIVES))
        for batch in batches:
            for side, ids, labels, v in _tiles(batch, sides):
                low, high, best = state[v.shape[1]]
                planes = planes_of(v)
                for lo in range(0, len(side.ids), ANCHORS):
                    own = np.arange(lo, min(lo + ANCHORS, len(side.ids)))
                    least = np.maximum(low, best.floor.reshape(low.shape))
                    least[least > high] = _MOST

                    def wanted(a, lower, upper, least=least):
                        fits = np.zeros(np.broadcast_shapes(a.shape, lower.shape), bool)
                        for p in range(POSITIVES):
                            fits |= (upper >= least[a, p]) & (lower <= high[a, p])  # noqa: B023
                        return fits

                    i, j, score = sliced(side, own, v, planes, wanted, side.labels[own][:, None] != labels[None, :])
                    for p in range(POSITIVES):
                        fit = (score >= low[i, p]) & (score <= high[i, p])
                        best.add(i[fit] * POSITIVES + p, score[fit], ids[j[fit]])
        for d, (_, _, best) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(sides[d].number[best.group // POSITIVES], pa.int64()), pa.array(best.group % POSITIVES + 1, pa.int32()), pa.array(best.ids, pa.int64()), pa.array(best.score, pa.int64())], names=["anchor", "place", "other", "score"])

    return rows.mapInArrow(run, "anchor long, place int, other long, score long")


def first_of(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their place from 1; groups are cut before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "other"))
    return found.withColumn("_place", place).where(F.col("_place") <= most)


def hard_negatives(rows: DataFrame, every: int = 50, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``every`` divides.
    """
    spark = rows.sparkSession
    data = scratch(whole_vectors(rows), "vectors")
    chosen = data.where(F.col("vec_id") % every == 0)
    size = chosen.agg(F.sum(8 * F.size("v") + 24)).first()[0] or 0
    passes = max(1, -(-size // anchor_bytes))
    # anchors have numbers of their own, as ids may repeat; a pass takes those of one hash
    numbered = scratch(chosen.select(F.monotonically_increasing_id().alias("anchor"), "*").withColumn("pass", F.pmod(F.xxhash64("anchor"), F.lit(passes))), "anchors")
    out = []
    for k in range(passes):
        anchors = spark.sparkContext.broadcast(numbered.where(F.col("pass") == k).drop("pass").toArrow())
        best = scratch(first_of(_positives(data, anchors), ["anchor"], POSITIVES).withColumnRenamed("_place", "place"), "positives")
        positives = spark.sparkContext.broadcast(best.select("anchor", "place", "score").toArrow())  # POSITIVES rows of an anchor
        found = first_of(_negatives(data, anchors, positives), ["anchor", "place"], NEGATIVES)
        known = best.select("anchor", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        rank = F.col("_place").cast("int").alias("rank")
        out.append(scratch(found.join(known, ["anchor", "place"]).select("anchor", "positive_id", F.col("place").cast("int").alias("positive_rank"), rank, F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        anchors.unpersist()
        positives.unpersist()
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    return result.join(numbered.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").drop("anchor")


def op12(rows: DataFrame) -> DataFrame:
    return hard_negatives(rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e AS a, e AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
