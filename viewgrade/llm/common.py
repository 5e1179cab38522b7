"""Helpers shared by the operators: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_dir

#: A side is broadcast only when its rows times the declared row width stay under this many bytes.
BROADCAST_BYTES = 32 << 20
#: Stands for a null id inside the operators, and turns into null again in their results.
NULL_ID = -(1 << 63)


_run: ContextVar[str] = ContextVar("run", default="")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, replicas are shared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}{_run.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder for the scratch tables of a run, which goes when the block ends.

    Results of operators read from these tables, so they are to be written within the block.
    """
    token = _run.set(f"/run-{uuid.uuid4().hex}")
    path = shared_dir(spark) + _run.get()
    try:
        yield path
    finally:
        _run.reset(token)
        remove(spark, path)


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join; broadcast ``right`` only if its counted size fits ``BROADCAST_BYTES``, else shuffle both sides."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows * row_bytes <= BROADCAST_BYTES else right.hint("merge"), on, how)


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of a block of edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components.  ``edges`` holds pairs of longs, neither null.

    Returns ``node, component`` with the smallest node of each component, for every node that has an edge
    to another one.  An edge lies with its larger node.  A pass merges the labels (smaller neighbours) of
    each node and hands the merged labels down as new edges, until every node has one label; doubling
    passes then follow the labels to the roots.  Neither gathers a component: a star's leaves stay apart.
    Each pass is written to the shared folder, so a lost executor costs one pass.
    """
    names = ["u", "v", "changed"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        if not parts or not sum(len(u) for u, _ in parts):
            return
        before = np.unique(np.column_stack([np.concatenate(x) for x in zip(*parts, strict=True)]), axis=0)
        node, label = least_labels(before[:, 0], before[:, 1])
        node, label = node[node != label], label[node != label]
        at = np.searchsorted(before[:, 0], node)
        single = np.searchsorted(before[:, 0], node, "right") - at == 1
        same = single & (before[np.minimum(at, len(before) - 1), 1] == label)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), pa.array(~same)], names=names)

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    while True:
        pairs = scratch(pairs.select("u", "v").repartition("u").mapInArrow(merge, "u long, v long, changed boolean"), "edges")
        if pairs.where("changed").isEmpty():
            break
    while True:
        up = pairs.select(F.col("u").alias("v"), F.col("v").alias("w"))
        pairs = scratch(pairs.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("changed")), "edges")
        if pairs.where("changed").isEmpty():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
