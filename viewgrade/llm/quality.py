"""Operator 6, quality rules: counting rules, and a classifier for what they let through.

The classifier is a logistic regression over hashed word 1- and 2-grams and character 4-grams, fitted to a
bounded sample of the labelled ids (``SAMPLE``), calibrated on held-out ones (Platt), and applied to whole
texts in Arrow batches against a fixed threshold.  The sample's features are a table in the shared folder; a round
of the fit broadcasts the weights, tasks add up their rows' gradients, and the driver takes one step (L-BFGS) with
the sums of the tasks, in the order of their rows, so that reruns agree.

Defined results: a null text has no words and fails the base rules; repeated rows are judged alike; a null or
unlabelled doc_id is no training row; several labels of one id are averaged (0.5 and more is good); without
labels of both classes only the base rules decide; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch
from .repeats import distinct

#: Labelled doc_ids that the classifier is fitted to, at most.
SAMPLE = 3000
#: Different texts of one doc_id among them, at most.
PER_ID = 16
#: Feature cells (8 bytes each) of the sample, at most: whole texts, in the order of their ids' hashes.
SAMPLE_CELLS = 1 << 26
#: Feature cells of one file of the sample, about, and those that a task works on at a time.
FILE_CELLS, CELLS = 1 << 20, 1 << 18
#: One of so many ids is held out of the fit, for the calibration.
HELD = 5
#: A text is kept from this calibrated probability of good quality on.
KEEP_FROM = 0.2
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
BITS = 16
FAMILIES = 3
ROUNDS, MEMORY, RIDGE = 25, 8, 1e-5
#: Doubles of a vector that travel as one row.
PIECE = 1 << 13
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


class Model(NamedTuple):
    """Weights by family and hash cell, bias, and the calibration of the logit; None judges nothing."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def per_row(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[borders])


def families(data: np.ndarray, offs: np.ndarray, values: np.ndarray, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, row borders) of the hashed features of each family, in row order."""
    shift = K.U(64 - BITS)
    yield (values >> shift).astype(np.int64), borders
    for units, rows, k in ((values, borders, 2), (K.BYTE_CODE[data], offs, 4)):
        ok = np.flatnonzero(K.in_row(rows, k, len(units)))
        gram = K.grams(units, k)
        yield (gram[ok] >> shift).astype(np.int64) if len(ok) else np.empty(0, np.int64), np.searchsorted(ok, rows)


def base_counts(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counting rules of a chunk; also its word hashes and their borders."""
    start, end, borders = K.words(data, offs)
    pre = K.prefix(K.BYTE_CODE[data], K.BASE)
    values = K.span_hash(pre, start, end, K.BASE)
    out = {"n_words": np.diff(borders), "word_chars": per_row(~K.BLANK[data] & ((data & 0xC0) != 0x80), offs), "n_symbols": per_row(SYMBOL[data], offs)}
    # lines end at \n and at the borders of rows
    line_end = np.sort(np.concatenate([np.flatnonzero(data == 10), offs[1:]]), kind="stable")
    line_start = np.append(0, line_end[:-1] + 1)
    row = np.searchsorted(offs, line_end, "left") - 1
    line_start = np.maximum(line_start, offs[np.maximum(row, 0)])
    line_start[1:] = np.where(line_end[:-1] == offs[np.maximum(row[1:], 0)], offs[np.maximum(row[1:], 0)], line_start[1:])
    some = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[some], line_end[some]
    row = np.searchsorted(offs, line_start, "right") - 1
    hashes = K.span_hash(pre, line_start, line_end, K.BASE)
    order = np.lexsort((hashes, row))
    again = ~distinct(row[order], hashes[order])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=len(offs) - 1)
    ok = np.flatnonzero(K.in_row(borders, WINDOW, len(values)))
    repeated = np.zeros(len(values), bool)
    if len(ok):
        gram, at = K.grams(values, WINDOW)[ok], np.searchsorted(borders, ok, "right") - 1
        order = np.lexsort((gram, at))
        new = distinct(at[order], gram[order])
        twice = ok[order][~(new & np.append(new[1:], True))]
        repeated = K.cover(twice, twice + WINDOW, len(values))
    out["n_repeat_words"] = per_row(repeated, borders)
    return out, values, borders


def judge(batch: pa.RecordBatch, model: Model | None) -> dict[str, np.ndarray]:
    parts = []
    for _, _, data, offs in K.text_chunks(batch):
        out, values, borders = base_counts(data, offs)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
        logit = np.zeros(len(offs) - 1)
        if model is None:
            out["quality"] = np.ones(len(logit))
        else:
            for weights, (cell, rows) in zip(model.weights, families(data, offs, values, borders), strict=True):
                total = np.append(0.0, np.cumsum(weights[cell]))
                logit += (total[rows[1:]] - total[rows[:-1]]) / np.maximum(1, np.diff(rows))
            out["quality"] = 1 / (1 + np.exp(-np.clip(model.slope * (logit + model.bias) + model.shift, -40, 40)))
        out["kept"] = ~out["base_failed"] & (out["quality"] >= KEEP_FROM)
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the sample in turn: which rows, and of their cells the cell, the share and the row within the block."""
    offs = np.append(0, np.cumsum(batch.column("n").to_numpy()))
    lo = 0
    while lo < len(batch):
        end = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CELLS, "right")) - 1)
        col, val = (np.frombuffer(b"".join(batch.column(c).slice(lo, end - lo).to_pylist()), kind) for c, kind in (("cells", np.int32), ("shares", np.float32)))
        yield slice(lo, end), col, val.astype(np.float64), np.repeat(np.arange(end - lo), np.diff(offs[lo : end + 1]))
        lo = end


def features(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, list]:
    """Hashed features of a bounded sample of labelled ids, the smallest hashes of doc_id, a bounded number of texts each.

    Also the rows without their features, which are few.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = F.broadcast(chosen)  # at most `sample` rows of 9 bytes
    labelled = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(rows, "_id")
    # one text of each hash class, found in the map side too: an id of many rows is never gathered
    text_hash = F.xxhash64("text")
    labelled = labelled.groupBy("_id", "good", F.pmod(text_hash, F.lit(PER_ID)).alias("class")).agg(F.min(F.struct(text_hash.alias("text_hash"), F.col("text"))).alias("least")).select("_id", "good", "least.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, shares = [], []
            for _, _, data, offs in K.text_chunks(batch):
                start, end, borders = K.words(data, offs)
                found = list(families(data, offs, K.word_hashes(data, start, end), borders))
                for i in range(len(offs) - 1):
                    row = [np.unique(cell[b[i] : b[i + 1]], return_counts=True) for cell, b in found]
                    cells.append(np.concatenate([c + (f << BITS) for f, (c, _) in enumerate(row)]).astype(np.int32).tobytes())
                    shares.append(np.concatenate([n / max(1, n.sum()) for _, n in row]).astype(np.float32).tobytes())
            n = pa.array([len(c) // 4 for c in cells], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "text_hash", "good")), n, pa.array(cells, pa.binary()), pa.array(shares, pa.binary())], names=["id", "text_hash", "good", "n", "cells", "shares"])

    table = scratch(labelled.mapInArrow(K.released(count), "id long, text_hash long, good boolean, n long, cells binary, shares binary"), "features")
    table = table.withColumns({"place": F.xxhash64("id"), "held": F.pmod(F.xxhash64("id", F.lit(HELD)), F.lit(HELD)) == 0})
    rows = sorted(table.select("place", "id", "text_hash", "n", "good", "held").collect())
    rows = rows[: int(np.searchsorted(np.cumsum([r.n for r in rows]), SAMPLE_CELLS, "right"))]
    if not rows:
        return table.limit(0), rows
    last = F.struct(*(F.lit(rows[-1][c]).cast("long").alias(c) for c in ("place", "id", "text_hash")))
    inside = table.where(F.struct("place", "id", "text_hash") <= last)
    files = -(-sum(r.n for r in rows) // FILE_CELLS)
    return scratch(inside.repartition(files, "id", "text_hash").sortWithinPartitions("id", "text_hash"), "sample"), rows


def platt(logit: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate the logit, by Newton steps with a small ridge; slope stays positive."""
    x, theta = np.column_stack([logit, np.ones(len(logit))]), np.array([1.0, 0.0])
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return (float(theta[0]), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else (1.0, 0.0)


def summed(table: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (``size`` doubles) over the rows: a vector a task, added up in the order of their first rows.

    Vectors travel in pieces to the task that adds them up; the driver gets one vector, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, np.zeros(size)
        for batch in batches:
            if len(batch):
                first = first or (batch.column("id")[0].as_py(), batch.column("text_hash")[0].as_py())
                total += work(batch)
        for at in range(0, size if first is not None else 0, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([first[0]]), pa.array([first[1]]), pa.array([total[at : at + PIECE].tobytes()])], names=["piece", "id", "text_hash", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.empty(0)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([total.tobytes()])], names=["piece", "total"])
        for batch in batches:
            for at, part in zip(batch.column("piece").to_pylist(), batch.column("total"), strict=True):
                if at != piece:
                    if piece is not None:
                        yield out()
                    piece, total = at, np.zeros(min(PIECE, size - at))
                total += np.frombuffer(part.as_buffer())
        if piece is not None:
            yield out()

    # a vector for each file of the sample at most: 64
    vectors = table.mapInArrow(K.released(run), "piece long, id long, text_hash long, total binary").repartition(1).sortWithinPartitions("piece", "id", "text_hash")
    total = np.zeros(size)
    for r in vectors.mapInArrow(K.released(add), "piece long, total binary").collect():
        total[r.piece : r.piece + PIECE] = np.frombuffer(r.total)
    return total


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, rounds: int = ROUNDS) -> np.ndarray:
    """A point of small ``value`` (and gradient), by limited-memory BFGS with halved steps; ``rounds`` values at most."""
    x = np.zeros(size)
    f, g = value(x)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    step = None
    for _ in range(rounds - 1):
        if step is None:
            if not g.any():
                break
            q, kept = -g, []
            for s, y in reversed(past):
                kept.append((s @ q) / (s @ y))
                q = q - kept[-1] * y
            q = q * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
            for (s, y), a in zip(past, reversed(kept), strict=True):
                q = q + (a - (y @ q) / (s @ y)) * s
            step = 1.0
        there = x + step * q
        f_there, g_there = value(there)
        if f_there > f + 1e-4 * step * (g @ q):
            step /= 2
            continue
        if (there - x) @ (g_there - g) > 1e-12:
            past.append((there - x, g_there - g))
        x, f, g, step = there, f_there, g_there, None
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    table, rows = features(docs, labels, sample)
    if len({r.good for r in rows}) < 2:
        return None
    apart = all(len({r.good for r in rows if r.held == held}) == 2 for held in (True, False))
    train, test = (table.where("not held"), table.where("held")) if apart else (table, table)
    width, context = FAMILIES << BITS, docs.sparkSession.sparkContext
    # each class counts alike
    classes = [sum(1 for r in rows if r.good == good and not (apart and r.held)) for good in (False, True)]
    share = np.array([0.5 / n for n in classes])

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        weight, out = share[batch.column("good").to_numpy(zero_copy_only=False).astype(int)], np.zeros(width)
        for at, col, val, row in blocks(batch):
            out += np.bincount(col, val * val * weight[at][row], width)
        return out

    # cells are scaled by their spread, as in AdaGrad's first step
    spread = summed(train, squares, width)
    scale = 1 / np.sqrt(spread + 1e-8)
    scale = np.minimum(scale, np.median(scale[spread > 0])) if spread.any() else scale
    ridge = RIDGE * float(spread @ (scale * scale))

    def logits(batch: pa.RecordBatch, w: np.ndarray, bias: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at, col, val, row in blocks(batch):
            yield at, col, val, row, np.bincount(row, val * w[col], at.stop - at.start) + bias

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((scale * x[:-1], float(x[-1])))  # of fixed size

        def gradient(batch: pa.RecordBatch) -> np.ndarray:
            good, out = batch.column("good").to_numpy(zero_copy_only=False).astype(int), np.zeros(width + 2)
            for at, col, val, row, logit in logits(batch, *shared.value):
                weight, y = share[good[at]], good[at]
                error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
                out[:width] += np.bincount(col, val * error[row], width)
                out[width:] += error.sum(), (weight * np.logaddexp(0, np.where(y, -logit, logit))).sum()
            return out

        out = summed(train, gradient, width + 2)
        shared.destroy()
        w = x[:-1]
        return float(out[-1] + ridge / 2 * (w @ w)), np.append(out[:width] * scale + ridge * w, out[width])

    x = minimise(loss, width + 1)
    model = context.broadcast((scale * x[:-1], float(x[-1])))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [logit for *_, logit in logits(batch, *model.value)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_hash", "good")), pa.array(np.concatenate([np.empty(0), *found]))], names=["id", "text_hash", "good", "logit"])

    found = sorted(test.mapInArrow(K.released(judged), "id long, text_hash long, good boolean, logit double").collect())
    slope, shift = platt(np.array([r.logit for r in found]), np.array([r.good for r in found]))
    return Model((scale * x[:-1]).reshape(FAMILIES, -1).astype(np.float32), float(x[-1]), slope, shift)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "quality": "double"}


def quality_rules(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and the verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 3 x 2**16 weights
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = judge(batch, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(found[c], kinds[t]) for c, t in COLUMNS.items())], names=["doc_id", *COLUMNS])

    return docs.select("doc_id", "text").mapInArrow(K.released(run), "doc_id long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose text is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(judge(batch, shared.value)["kept"]))

    return docs.mapInArrow(K.released(run), docs.schema)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, fit(docs, labels))
