"""Records of JSON-array files, read by byte ranges.

A file is one array, but any number of tasks can read it: Spark's text source splits files at closing braces, and a
piece between two of them is handled as bytes.  Whether a range begins inside a string, and how deep, is not known to its
task; so a first pass sums each range up for both answers (the parity of its quotes, the change of depth, and at each
relative depth the braces, commas and brackets that open there), and a prefix over the ranges of a file, one row each,
settles them.  The second pass knows the state its range begins in, cuts the records out and numbers them.  A record that
runs over the border of ranges is put together from its parts.  Where no file can have two ranges, the first pass is left out.

A file holds an array of objects; other elements, or anything before or after the array, make it a fault of the file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The state of ranges is broadcast while it is smaller than this, by a bound on their number.
BROADCAST_BYTES, STATE_BYTES = 32 << 20, 256
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE, BEGIN, END = b'"\\,{}[]'
KIND = np.zeros(256, bool)
KIND[[COMMA, OPEN, CLOSE, BEGIN, END]] = True
STEP = np.zeros(256, np.int64)
STEP[[OPEN, BEGIN]], STEP[[CLOSE, END]] = 1, -1
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\r\n")] = True
GLUE = SPACE.copy()
GLUE[[COMMA, BEGIN, END]] = True


def _reader(spark: SparkSession, pattern: str, recursive: bool):
    reader = spark.read.option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", True) if recursive else reader


def listing(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool = False) -> DataFrame:
    """file_path, length of the files that are not empty: no content is read."""
    return _reader(spark, pattern, recursive).format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"), "length")


def empty_files(files: DataFrame, n: int) -> DataFrame | None:
    """file_path of the files of a ``listing`` that Spark leaves out, as they have no bytes; n: those it has."""
    listed = files._jdf.inputFiles()
    if len(listed) == n:
        return None
    # the two write a path without a host in different ways
    names = [(re.sub("^([a-z0-9]+:)///", r"\1/", f),) for f in listed]
    return files.sparkSession.createDataFrame(names, "file_path string").join(files, "file_path", "left_anti")


def pieces(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool) -> DataFrame:
    """file_path, block (where the range begins), value: what lies between closing braces, in order within a range."""
    meta = F.col("_metadata")
    return _reader(spark, pattern, recursive).option("lineSep", "}").text(path).select(meta["file_path"].alias("file_path"), meta["file_block_start"].alias("block"), "value")


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of structural bytes, parity of the quotes before each, number of quotes).  An escape never runs over
    a piece's border, as a brace after a backslash has no meaning anyway."""
    quotes = np.flatnonzero(data == QUOTE)
    back = data == BACKSLASH
    if len(quotes) and back.any():
        plain = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))
        before = quotes - 1
        run = before - np.where(before >= 0, plain[before], -1)
        quotes = quotes[run % 2 == 0]
    at = np.flatnonzero(KIND[data])
    return at, np.searchsorted(quotes, at) & 1, len(quotes)


def range_bytes(values: pa.Array, first: bool) -> np.ndarray:
    """The bytes of consecutive pieces, each with the brace that comes before it; the first of a file has none."""
    values = values.cast(pa.large_binary())
    n = len(values)
    offs = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8)
    size = int(offs[-1] - offs[0])
    out = np.full(size + n, CLOSE, np.uint8)
    text = np.ones(size + n, bool)
    text[offs[:-1] - offs[0] + np.arange(n)] = False
    if size:
        out[text] = np.frombuffer(values.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return out[1:] if first else out


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first row, last row + 1) of the ranges of a batch."""
    path, block, n = batch.column("file_path"), batch.column("block"), batch.num_rows
    if not n:
        return
    new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
    borders = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for lo, hi in zip(borders, borders[1:], strict=False):
        yield path[lo].as_py(), block[lo].as_py(), lo, hi


def _counts(total: dict[int, int], depth: np.ndarray) -> None:
    for d, n in zip(*np.unique(depth, return_counts=True), strict=True):
        total[int(d)] = total.get(int(d), 0) + int(n)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: what it does to a state, for a start outside (0) and inside (1) of a string."""
    key, sums = None, {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([json.dumps(sums)])], names=["file_path", "block", "sums"])

    for batch in batches:
        for path, block, lo, hi in stretches(batch):
            fresh = (path, block) != key
            if fresh:
                if key is not None:
                    yield out()
                key, sums = (path, block), {"quotes": 0, "depth": [0, 0], "braces": [{}, {}], "commas": [{}, {}], "brackets": [{}, {}], "head": 0, "tail": 0}
            data = range_bytes(batch.column("value").slice(lo, hi - lo), fresh and block == 0)
            at, parity, quotes = marks(data)
            for start in (0, 1):
                kind = data[at[parity == start ^ (sums["quotes"] & 1)]]
                step = STEP[kind]
                before = sums["depth"][start] + np.cumsum(step) - step
                for name, byte in (("braces", OPEN), ("commas", COMMA), ("brackets", BEGIN)):
                    _counts(sums[name][start], before[kind == byte])
                sums["depth"][start] += int(step.sum())
            sums["quotes"] += quotes
            solid = np.flatnonzero(~SPACE[data])
            if len(solid):
                sums["head"] = sums["head"] or int(data[solid[0]])
                sums["tail"] = int(data[solid[-1]])
    if key is not None:
        yield out()


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each range of a file begins, and whether the file ends as an array does."""
    pdf = pdf.sort_values("block")
    inside = depth = records = commas = opened = head = tail = 0
    rows = []
    for path, block, text in zip(pdf["file_path"], pdf["block"], pdf["sums"], strict=True):
        rows.append([path, block, bool(inside), depth, records, commas, opened])
        s = json.loads(text)
        of = lambda name, d: s[name][inside].get(str(d), 0)  # noqa: B023, E731
        records, commas, opened = records + of("braces", 1 - depth), commas + of("commas", 1 - depth), opened + of("brackets", -depth)
        depth += s["depth"][inside]
        inside ^= s["quotes"] & 1
        head, tail = head or s["head"], s["tail"] or tail
    whole = not inside and depth == 0 and opened == 1 and commas == max(records - 1, 0) and head == BEGIN and tail == END
    return pd.DataFrame([[*r, records, whole] for r in rows], columns=["file_path", "block", "inside", "depth", "first", "commas", "opened", "records", "whole"])


def range_states(spark: SparkSession, path: str | list[str], pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """A row for each range: file_path, block, the state it begins in, and of its file the records and whether it is whole."""
    sums = pieces(spark, path, pattern, recursive).mapInArrow(_sums, "file_path string, block long, sums string")
    return sums.groupBy("file_path").applyInPandas(_settled, "file_path string, block long, inside boolean, depth long, first long, commas long, opened long, records long, whole boolean")


class _Range:
    """Cuts the records out of one range, batch by batch.  Rows: (ord, seq, value, fault)."""

    def __init__(self, block: int, state: dict | None):
        s = state or {}
        self.block, self.alone = block, state is None
        self.inside, self.depth = int(s.get("inside", 0)), s.get("depth", 0)
        self.ord, self.commas, self.opened = s.get("first", 0), s.get("commas", 0), s.get("opened", 0)
        self.fault = not s.get("whole", True)
        self.held: list[bytes] | None = None  # of a record that began in this range
        self.seq, self.tail = 0, 0

    def feed(self, data: np.ndarray) -> tuple[list, list, list]:
        """(ords, seqs, values) of what this part completes."""
        ords, seqs, values = [], [], []
        if self.fault:
            return ords, seqs, values
        at, parity, quotes = marks(data)
        at = at[parity == self.inside]
        kind = data[at]
        step = STEP[kind]
        after = self.depth + np.cumsum(step)
        before = after - step
        starts, ends = at[(kind == OPEN) & (before == 1)], at[(kind == CLOSE) & (after == 1)]
        begins = np.flatnonzero((kind == BEGIN) & (before == 0))
        odd = (kind == END) & (after == 1) | (kind == BEGIN) & (before == 1) | (kind == CLOSE) & (after == 0) | (kind == OPEN) & (before == 0) | (after < 0)
        commas = self.commas + np.searchsorted(at[(kind == COMMA) & (before == 1)], starts)
        # outside of records there are blanks, the commas between them and the array's brackets
        within = np.zeros(len(data) + 1, np.int8)
        within[0] = self.depth >= 2
        within[starts] += 1
        within[ends + 1] -= 1
        glue = np.cumsum(within[:-1], dtype=np.int8) == 0
        if odd.any() or len(begins) + self.opened > 1 or (commas != self.ord + np.arange(len(starts))).any() or (glue & ~GLUE[data]).any():
            self.fault = True
            return ords, seqs, values
        raw = data.tobytes()
        if self.depth >= 2:  # a record goes on from before
            stop = int(ends[0]) + 1 if len(ends) else len(raw)
            if self.held is None:
                ords, seqs, values = [self.ord - 1], [self.seq], [raw[:stop]]
                self.seq += 1
            else:
                self.held.append(raw[:stop])
                if len(ends):
                    ords, seqs, values = [self.ord - 1], [None], [b"".join(self.held)]
                    self.held = None
            ends = ends[1:]
        n = min(len(starts), len(ends))
        ords += range(self.ord, self.ord + n)
        seqs += [None] * n
        values += [raw[a:b] for a, b in zip(starts[:n].tolist(), (ends[:n] + 1).tolist(), strict=True)]
        if len(starts) > n:
            self.held = [raw[int(starts[n]) :]]
        self.ord += len(starts)
        self.commas += int(((kind == COMMA) & (before == 1)).sum())
        self.opened += len(begins)
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside ^= quotes & 1
        solid = np.flatnonzero(~SPACE[data])
        self.tail = int(data[solid[-1]]) if len(solid) else self.tail
        return ords, seqs, values

    def end(self) -> tuple[list, list, list]:
        """What is left of a record that the next range goes on with."""
        if self.alone and not self.fault:
            self.fault = not (self.inside == 0 and self.depth == 0 and self.opened == 1 and self.commas == max(self.ord - 1, 0) and self.tail == END)
        return ([self.ord - 1], [self.seq], [b"".join(self.held)]) if self.held is not None and not self.fault else ([], [], [])


_STATE = ("inside", "depth", "first", "commas", "opened", "whole")
_CUT = "file_path string, block long, ord long, seq long, value string, fault boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(key, ords, seqs, values, fault=False) -> pa.RecordBatch:
        n = len(ords)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(ords, pa.int64()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary()).view(pa.string()), pa.array([fault] * n, pa.bool_())], names=["file_path", "block", "ord", "seq", "value", "fault"])

    def close(key, own) -> Iterator[pa.RecordBatch]:
        yield out(key, *own.end())
        if own.fault or key[1] == 0:  # a file's first range says that there is one
            yield out(key, [None], [None], [None], own.fault)

    key = own = None
    for batch in batches:
        for path, block, lo, hi in stretches(batch):
            fresh = (path, block) != key
            if fresh:
                if own is not None:
                    yield from close(key, own)
                key = (path, block)
                own = _Range(block, {c: batch.column(c)[lo].as_py() for c in _STATE} if "inside" in batch.schema.names else None)
            for at in range(lo, hi, 2048):
                yield out(key, *own.feed(range_bytes(batch.column("value").slice(at, min(2048, hi - at)), fresh and block == 0 and at == lo)))
    if own is not None:
        yield from close(key, own)


def record_texts(spark: SparkSession, path: str | list[str], pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """file_path, ord, value, fault: a row for each record, one without ``ord`` for each file, and those with a fault."""
    conf = spark._jsparkSession.sessionState().conf()
    least = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())  # no range of several is smaller
    files = listing(spark, path, pattern, recursive)
    bound = files.agg(F.sum(F.ceil(F.col("length") / least)).alias("ranges"), F.max("length").alias("most"), F.count(F.lit(1)).alias("n")).first()
    text = pieces(spark, path, pattern, recursive)
    if (bound.most or 0) <= least:
        found = text.mapInArrow(_cut, _CUT).select("file_path", "ord", "value", "fault")
    else:
        states = range_states(spark, path, pattern, recursive).select("file_path", "block", *_STATE)
        if bound.ranges * STATE_BYTES <= BROADCAST_BYTES:
            states = spark.createDataFrame(states.toPandas(), states.schema)  # bounded as above, and read by two branches
            known = text.join(F.broadcast(states), ["file_path", "block"])  # rows stay where they are, in order
        else:
            known = text.withColumn("_place", F.monotonically_increasing_id()).join(states.hint("merge"), ["file_path", "block"])
            known = known.repartition("file_path", "block").sortWithinPartitions("file_path", "block", "_place").drop("_place")
        cut = known.mapInArrow(_cut, _CUT)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))), lambda x: x["value"])
        over = cut.where("seq IS NOT NULL").groupBy("file_path", "ord").agg(F.array_join(parts, "").alias("value"), F.lit(False).alias("fault"))
        found = cut.where("seq IS NULL").select("file_path", "ord", "value", "fault").unionByName(over)
    if (empty := empty_files(files, bound.n)) is not None:
        found = found.unionByName(empty.select("file_path", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("fault")))
    return found
