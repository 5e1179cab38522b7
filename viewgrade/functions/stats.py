"""Rank and correlation statistics (A3-A7, W1), grouped or global.

Equal (group, x, y) rows are counted first.  What is left is dealt into partitions by ranges of (group, value), of as many
rows as Spark's range partitioner finds even, so neither a group nor a value that many rows share lies in one task: a rank is a
running count within a partition plus the counts of the partitions before it.  Kendall's tau counts concordant pairs digit
by digit of the ranks, each digit in one pass over partitions dealt in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

LEAST = 3
#: Bits of a rank that one pass over the rows settles.
DIGIT = 10


def pearson(x: str, y: str) -> Column:
    """A3: 0 below three rows, NaN where a side is constant (an unguarded corr would raise)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.when(F.count(F.lit(1)) < LEAST, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(float("nan"))))


def rmse(x: str, y: str) -> Column:
    """A5: without a least number of rows."""
    return F.sqrt(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name, where null equals null; left's columns stay."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & left[c].eqNullSafe(right[f"__{c}"])
    return left.join(right, test, how).drop(*[f"__{c}" for c in on])


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt into ranges of an order, with the number of their range: ``_part`` rises with the order.

    The result is written once, as two readings of a range shuffle may have two sets of bounds.
    """
    return stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")


def before(parts: DataFrame, by: list[str], amount: str, *order: Column | str) -> DataFrame:
    """``parts`` (a row for each group and range) with ``_before``, the sum of the group's ranges before it, and ``_all``."""
    group = Window.partitionBy(*by)
    running = F.sum(amount).over(group.orderBy(*(order or ("_part",))).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_before", F.coalesce(running, F.lit(0))).withColumn("_all", F.sum(amount).over(group))


def ranks(counted: DataFrame, by: list[str], value: str) -> DataFrame:
    """By, value, rows (that have it), rank, centred (rank less the mean rank), place (of the distinct values from 0), places.

    ``counted`` has a row count ``m``.  Ties have their mean rank; nulls come first.
    """
    values = dealt(counted.groupBy(*by, value).agg(F.sum("m").alias("_n")), *by, value)
    own = values.groupBy(*by, "_part").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    offsets = before(own, by, "_rows").select(*by, "_part", "_before", "_all", "_values")
    offsets = before(offsets.withColumnsRenamed({"_before": "_rows_before", "_all": "_rows_all"}), by, "_values").drop("_values")
    upto = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = values.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_at", F.count(F.lit(1)).over(upto) - 1)
    placed = joined(local, offsets, [*by, "_part"])
    rank = F.col("_rows_before") + F.col("_upto") - (F.col("_n") - 1) / 2
    return placed.select(*by, value, F.col("_n").alias("rows"), rank.alias("rank"), (rank - (F.col("_rows_all") + 1) / 2).alias("centred"), (F.col("_before") + F.col("_at")).alias("place"), F.col("_all").alias("places"))


def with_average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """W1 as a column of every row."""
    found = ranks(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m")), by, value)
    return joined(df, found.select(*by, value, F.col("rank").alias(name)), [*by, value])


def _correlation(x: Column, y: Column) -> Column:
    """Of weighted rows, ``x`` and ``y`` being near 0."""
    n = F.sum("m")
    mean = lambda v: F.sum(F.col("m") * v) / n
    spread = lambda v: F.sqrt(F.greatest(mean(v * v) - mean(v) * mean(v), F.lit(0.0)))
    r = (mean(x * y) - mean(x) * mean(y)) / F.nullif(spread(x) * spread(y), F.lit(0.0))
    within = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return F.when(n < LEAST, F.lit(0.0)).otherwise(F.coalesce(within, F.lit(float("nan"))))


def _counted(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, _x, _y, m: how many rows are equal; the input is read here and no more."""
    return stage(df.groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("m")), "counted")


def _sides(counted: DataFrame, by: list[str]) -> DataFrame:
    """Ranks of both columns in one pass, as groups of their own: by, _side (_x or _y), _v and what ``ranks`` gives.

    They are running sums over the dealt values, so a reader of one side pays for that side alone.
    """
    sides = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_v")) for c in ("_x", "_y")])
    return ranks(counted.select(*by, "m", F.inline(sides)), [*by, "_side"], "_v")


def _with_side(counted: DataFrame, sides: DataFrame, by: list[str], side: str, **columns: str) -> DataFrame:
    """``counted`` with columns of the ranks of one side, by their new names."""
    own = sides.where(F.col("_side") == side).select(*by, F.col("_v").alias(side), *[F.col(c).alias(name) for name, c in columns.items()])
    return joined(counted, own, [*by, side])


def _quality(counted: DataFrame, sides: DataFrame, by: list[str]) -> DataFrame:
    rows = _with_side(_with_side(counted, sides, by, "_x", _rx="centred"), sides, by, "_y", _ry="centred")
    mean = lambda c: F.sum(F.col("m") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("m")))
    means = counted.groupBy(*by).agg(mean("_x").alias("_mx"), mean("_y").alias("_my"))
    rows = joined(rows, means, by)
    x, y = F.col("_x"), F.col("_y")
    square = F.col("m") * (x - y) * (x - y)
    return rows.groupBy(*by).agg(F.sum("m").alias("n"), _correlation(F.col("_rx"), F.col("_ry")).alias("srcc"), _correlation(x - F.col("_mx"), y - F.col("_my")).alias("plcc"), F.sqrt(F.sum(square) / F.sum("m")).alias("rmse"))


def quality_metrics(df: DataFrame, by: list[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """A7 without Kendall: n, srcc, plcc, rmse of each group."""
    counted = _counted(df, by, pred, target)
    return _quality(counted, _sides(counted, by), by)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """A4: by, srcc, n of each group; NaN where a value is missing."""
    counted = _counted(df, by, x, y)
    sides = _sides(counted, by)
    rows = _with_side(_with_side(counted, sides, by, "_x", _rx="centred"), sides, by, "_y", _ry="centred")
    missing = F.count_if(F.col("_x").isNull() | F.col("_y").isNull()) > 0
    srcc = F.when(missing, F.lit(float("nan"))).otherwise(_correlation(F.col("_rx"), F.col("_ry")))
    return rows.groupBy(*by).agg(srcc.alias("srcc"), F.sum("m").alias("n"))


def dominated(x: np.ndarray, y: np.ndarray, m: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each row j the sum of m[i] m[j] over rows i of its group with x[i] < x[j] and y[i] < y[j].

    By a bottom-up merge whose steps are vectorised.  Groups lie in rising order of x and in falling order of y, so
    rows of two groups never count.
    """
    n = len(x)
    group = np.zeros(n, np.int64) if group is None else group
    by_y = np.lexsort((y, -group))
    rank = np.empty(n, np.int64)
    rank[by_y] = np.cumsum(np.append(True, (np.diff(y[by_y]) != 0) | (np.diff(group[by_y]) != 0)))[:n]
    row = np.lexsort((-y, x, group))  # of equal x the larger y first, so that they never count
    out, width, at = np.zeros(n), 1, np.arange(n)
    while width < n:
        block, left = at // (2 * width), (at // width) % 2 == 0
        order = np.lexsort((left, rank[row], block))  # of equal y the right half first, for the same reason
        own = np.where(left, m[row], 0.0)[order]
        seen = np.cumsum(own) - own
        start = np.searchsorted(block[order], block[order])
        right = ~left[order]
        row = row[order]
        out[row[right]] += (m[row] * (seen - seen[start]))[right]
        width *= 2
    return out


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """A6 of two arrays: tau-b; 0 below three pairs, NaN where a side is constant."""
    n = len(x)
    if n < LEAST:
        return 0.0
    pairs = lambda c: float((c * (c - 1) // 2).sum())
    tx, ty = (pairs(np.unique(v, return_counts=True)[1]) for v in (x, y))
    both = pairs(np.unique(np.column_stack([x, y]), axis=0, return_counts=True)[1])
    return _tau(n * (n - 1) / 2, tx, ty, both, float(dominated(x, y, np.ones(n)).sum()))


def _tau(all_: float, tx: float, ty: float, both: float, concordant: float) -> float:
    if tx == all_ or ty == all_:
        return float("nan")
    return (2 * concordant - (all_ - tx - ty + both)) / np.sqrt((all_ - tx) * (all_ - ty))


def _smaller_before(node: np.ndarray, digit: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each row the sum of m over earlier rows of its node (nodes lie together) that have a smaller digit.

    Bit by bit: rows that agree in the bits above are neighbours, in their order, and those with a 1 count the 0s before.
    """
    out = np.zeros(len(node))
    for bit in range(DIGIT - 1, -1, -1):
        key = (node << (DIGIT - bit - 1)) | (digit >> (bit + 1))
        order = np.argsort(key, kind="stable")
        key, one = key[order], (digit[order] >> bit) & 1 == 1
        zeros = np.where(one, 0.0, m[order])
        seen = np.cumsum(zeros) - zeros
        seen -= seen[np.searchsorted(key, key)]
        out[order[one]] += seen[one]
    return out


def _pairs_of_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Concordant pairs within a partition, and the sums by digit of its first and last node, which may lie in others, too.

    Rows: _k (group), node, _part, digit, m, in order of (group, node, y rising, x falling).  A node goes on from batch to batch.
    """

    def out(key: tuple, part: int, pairs: float, sums: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_k": key[0], "node": key[1], "_part": part, "pairs": pairs, "sums": None if sums is None else sums.tolist()}], pa.schema([("_k", pa.string()), ("node", pa.int64()), ("_part", pa.int32()), ("pairs", pa.float64()), ("sums", pa.list_(pa.float64()))]))

    last, held, pairs, first = None, np.zeros(1 << DIGIT), 0.0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        group, nodes = batch.column("_k"), batch.column("node").to_numpy()
        digit, m, part = batch.column("digit").to_numpy().astype(np.int64), batch.column("m").to_numpy().astype(float), batch.column("_part")[0].as_py()
        new = np.append(True, np.diff(nodes) != 0)
        new[1:] |= pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(new)
        found = m * _smaller_before(np.cumsum(new), digit, m)
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(nodes)], strict=True):
            key = (group[lo].as_py(), int(nodes[lo]))
            if key != last:
                if last is not None and (first or pairs):
                    yield out(last, part, pairs, held if first else None)
                first = first and last is None
                last, pairs, held = key, 0.0, np.zeros(1 << DIGIT)
            smaller = np.cumsum(held) - held
            pairs += float(found[lo:hi].sum() + (m[lo:hi] * smaller[digit[lo:hi]]).sum())
            held += np.bincount(digit[lo:hi], m[lo:hi], 1 << DIGIT)
    if last is not None:
        yield out(last, part, pairs, held)


def _across(sums: pa.Table) -> pa.Table:
    """Concordant pairs of one node between its partitions, from their sums by digit."""
    rows = sums.sort_by("_part")
    total, seen = 0.0, np.zeros(1 << DIGIT)
    for own in rows.column("sums"):
        own = np.array(own.as_py())
        total += float((own * (np.cumsum(seen) - seen)).sum())
        seen += own
    return pa.table({"_k": rows.column("_k").slice(0, 1), "pairs": pa.array([total])})


def _kendall(counted: DataFrame, sides: DataFrame, by: list[str]) -> DataFrame:
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = _with_side(counted, sides, by, "_x", _place="place", _places="places").select(key.alias("_k"), "_y", "m", "_place", "_places")
    rows = stage(rows, "places")
    most, found = rows.agg(F.max("_places")).first()[0] or 1, None
    for level in range(max(1, -(-int(most - 1).bit_length() // DIGIT))):
        # groups whose places have no such digit have no pair here
        own = rows.where(F.col("_places") > (1 << (DIGIT * level)) if level else F.lit(True))
        node, digit = F.shiftright("_place", DIGIT * (level + 1)), F.shiftright("_place", DIGIT * level).bitwiseAND((1 << DIGIT) - 1)
        own = own.select("_k", node.alias("node"), "_y", F.col("_place"), digit.cast("int").alias("digit"), "m")
        order = ["_k", "node", "_y", F.desc("_place")]
        own = own.repartitionByRange(*order).sortWithinPartitions(*order).select("_k", "node", "digit", "m", F.spark_partition_id().alias("_part"))
        part = own.mapInArrow(_pairs_of_digit, "_k string, node long, _part int, pairs double, sums array<double>").withColumn("level", F.lit(level))
        found = part if found is None else found.unionByName(part)
    found = stage(found, "pairs")
    across = found.where("sums IS NOT NULL").groupBy("level", "_k", "node").applyInArrow(lambda t: _across(t.select(["_k", "_part", "sums"])), "_k string, pairs double")
    concordant = found.select("_k", "pairs").unionByName(across).groupBy("_k").agg(F.sum("pairs").alias("_c"))
    pairs = lambda c: F.sum(c.cast("double") * (c - 1) / 2)
    ties = sides.groupBy(*by).agg(*[F.coalesce(pairs(F.when(F.col("_side") == side, F.col("rows"))), F.lit(0.0)).alias(name) for side, name in (("_x", "_tx"), ("_y", "_ty"))])
    sums = joined(counted.groupBy(*by).agg(F.sum("m").alias("_n"), pairs(F.col("m")).alias("_both")), ties, by).withColumn("_k", key).join(concordant, "_k")
    all_ = F.col("_n").cast("double") * (F.col("_n") - 1) / 2
    spread = F.sqrt((all_ - F.col("_tx")) * (all_ - F.col("_ty")))
    tau = (2 * F.col("_c") - (all_ - F.col("_tx") - F.col("_ty") + F.col("_both"))) / F.nullif(spread, F.lit(0.0))
    return sums.select(*by, F.when(F.col("_n") < LEAST, F.lit(0.0)).otherwise(F.coalesce(tau, F.lit(float("nan")))).alias("kendall_tau"))


def kendall_by(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """By, kendall_tau (tau-b; 0 below three pairs, NaN where a side is constant) of each group.

    Two rows of different x differ first in some digit of their places, so pairs are counted digit by digit: among rows that
    agree in the digits above, ordered by y, a row makes a pair with those before it that have a smaller digit.  The order is
    dealt into ranges; pairs within one are counted there, pairs of different ranges by the ranges' sums for each digit.
    """
    counted = _counted(df, by, x, y)
    return _kendall(counted, _sides(counted, by), by)


def all_metrics(df: DataFrame, by: list[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """N, srcc, plcc, rmse, kendall_tau of each group."""
    counted = _counted(df, by, pred, target)
    sides = _sides(counted, by)
    return joined(_quality(counted, sides, by), _kendall(counted, sides, by), by)
