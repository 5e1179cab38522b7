"""Resumable scoring as a stream (the one stateful behaviour of the flow): a run takes what is new and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..operators.scoring import Scorer, score_batches
from .observed import RunTable, StreamFigures, counted


def score_stream(spark: SparkSession, source: str, schema: str, scorer: Scorer, sink: str, checkpoint: str, figures: RunTable | None = None, total: int | None = None) -> int:
    """Score the Parquet files that no earlier run with this checkpoint has seen; returns the rows written.

    The checkpoint names finished files and the sink commits per batch, so a lost run is repeated, not doubled.  Rows are
    counted as they pass; with ``figures``, each batch leaves a line there.
    """
    name = f"rows-{uuid.uuid4().hex}"
    out = score_batches(spark.readStream.schema(schema).parquet(source), scorer)
    seen = StreamFigures(name, checkpoint, total)
    spark.streams.addListener(seen)
    try:
        watched = out.observe(name, *counted(out))
        query = watched.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch's figures come by it
    finally:
        spark.streams.removeListener(seen)
    if figures is not None:
        figures.append(seen.lines)
    return seen.done
