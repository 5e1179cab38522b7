"""Scorers as map-batches functions (U1-U9, U12, U18-U20): models plug in, the engine runs them in Arrow batches."""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Rows of a part that one task scores, about.
TASK_ROWS = 20_000


class Scorer(Protocol):
    """A model: ``prepare`` once a task, then ``score`` for each batch, one value or text a row, in order.

    One that reads few columns may name them in ``columns``; ``annotate`` then takes no others to it.
    """

    def prepare(self) -> None: ...

    def score(self, rows: pd.DataFrame) -> list: ...


class ConstantScorer:
    """U2."""

    def __init__(self, value: float = 0.5):
        self.value, self.ready = value, False

    def prepare(self) -> None:
        self.ready = True

    def score(self, rows: pd.DataFrame) -> list:
        if not self.ready:
            raise RuntimeError("prepare() comes first")
        return [self.value] * len(rows)


class WordCounts:
    """A stand-in for a scoring model: a question's words by ``per``; a batch with a missing question fails."""

    columns = ["question"]

    def __init__(self, per: float = 10):
        self.per = per

    def prepare(self) -> None:
        pass

    def score(self, rows: pd.DataFrame) -> list:
        questions = rows["question"].tolist()
        if not all(isinstance(q, str) for q in questions):
            raise ValueError("no question")
        return [len(q.split()) / self.per for q in questions]


class EchoAnswers:
    """A stand-in for a describing model: the question's words, fewer the stronger the distortion."""

    def prepare(self) -> None:
        pass

    def score(self, rows: pd.DataFrame) -> list:
        keep = 1 - rows["intensity"] if "intensity" in rows else pd.Series(1.0, index=rows.index)
        return [" ".join(w[: max(0, round(len(w) * k))]) for w, k in zip(rows["question"].str.split(), keep, strict=True)]


def score_batches(rows: DataFrame, scorer: Scorer, batch: int = 16, column: str = "score", kind: str = "double") -> DataFrame:
    """Rows with the scorer's values and an ``error`` where it failed.

    A failing batch is tried row by row, so that only the failing rows stay without a value; a batch of the
    wrong length is a failure.
    """
    schema = StructType([*rows.schema.fields]).add(column, kind).add("error", "string")

    def one(scorer: Scorer, part: pd.DataFrame) -> tuple[list, list]:
        try:
            values = scorer.score(part)
            if len(values) != len(part):
                raise ValueError(f"{len(values)} values for {len(part)} rows")
            return list(values), [None] * len(part)
        except Exception as e:  # noqa: BLE001  a model's failure is a row's error, not the job's
            if len(part) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            each = [one(scorer, part.iloc[i : i + 1]) for i in range(len(part))]
            return [v for x, _ in each for v in x], [v for _, x in each for v in x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.prepare()
        for pdf in batches:
            found = [one(scorer, pdf.iloc[i : i + batch]) for i in range(0, len(pdf), batch)]
            yield pdf.assign(**{column: [v for x, _ in found for v in x], "error": [v for _, x in found for v in x]})

    return rows.mapInPandas(run, schema)


def score_tensors(rows: DataFrame, scorer: Scorer, columns: dict[str, list[int] | None], batch: int = 16, column: str = "score") -> DataFrame:
    """Rows with the values of a model of numbers; ``columns``: its inputs, with the shape of a tensor or None for a number.

    A model is prepared once in a worker and kept there for all tasks and batches.  A failing batch fails the job; for
    models that may fail on a row, and for texts, there is ``score_batches``.
    """
    names = list(columns)

    def make():
        scorer.prepare()

        def predict(*tensors: np.ndarray) -> np.ndarray:
            return np.asarray(scorer.score(pd.DataFrame({n: list(t) for n, t in zip(names, tensors, strict=True)})), np.float64)

        # one parameter for each input, as the wrapper tells inputs apart by them
        predict.__signature__ = inspect.Signature([inspect.Parameter(f"x{i}", inspect.Parameter.POSITIONAL_ONLY) for i in range(len(names))])
        return predict

    shapes = [shape or [] for shape in columns.values()] if any(columns.values()) else None
    model = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=shapes)
    return rows.withColumn(column, model(*[F.col(n) for n in names]))


def score_with_references(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Answers for both sides, the reference's computed once for each distinct (image, question)."""
    refs = score_batches(rows.select("ref_image", "question").distinct(), scorer, column="ref_answer", kind="string").withColumnRenamed("error", "ref_error")
    dists = score_batches(rows, scorer, column="dist_answer", kind="string")
    joined = dists.join(refs, ["ref_image", "question"])
    return joined.withColumn("error", F.coalesce("error", "ref_error")).drop("ref_error")


def score_prompts(rows: DataFrame, scorer: Scorer, key: str = "sample_id") -> DataFrame:
    """U5, U7, U8 with several prompts: key, mean bleu, rouge_l and cider, cognitive_score, and details by prompt.

    ``rows``: key, ref_image, prompts (a list), and what else the scorer reads.  A prompt that fails has an error in
    the details and is left out of the means; without any other the score is null.
    """
    from ..functions import text

    each = rows.select(*[c for c in rows.columns if c != "prompts"], F.posexplode("prompts").alias("_at", "question"))
    scored = answer_similarity(score_with_references(each, scorer))
    fine = F.col("error").isNull()
    figures = [F.avg(F.when(fine, F.col(c))).alias(c) for c in ("bleu", "rouge_l", "cider")]
    details = F.array_sort(F.collect_list(F.struct("_at", "question", "ref_answer", "dist_answer", "bleu", "rouge_l", "cider", "error")))
    out = scored.groupBy(key).agg(*figures, F.transform(details, lambda d: d.dropFields("_at")).alias("details"))
    return out.withColumn("cognitive_score", F.bround(text.combined(F.col("bleu"), F.col("rouge_l"), F.col("cider")), 6))


def answer_similarity(rows: DataFrame) -> DataFrame:
    """T4, T5, T8, T9 of ref_answer and dist_answer; blank sides score 0."""
    from ..functions import text

    t = text.similarities(rows, "ref_answer", "dist_answer")
    return t.withColumn("cognitive_score", F.bround(text.combined(F.col("bleu"), F.col("rouge_l"), F.col("cider")), 6))


def truth_similarity(rows: DataFrame) -> DataFrame:
    """Both metrics of gt_answer, ref_answer and dist_answer, with the flag of a failed baseline."""
    from ..functions import text

    return text.with_truth(rows)


def annotate(samples: DataFrame, scorer: Scorer, model: str, progress, cap: int | None = None, per_commit: int = 1_000_000, batch: int = 16) -> DataFrame:
    """Score what the progress table doesn't have and record it, failures with their error; the model's states.

    What is pending is found once.  Work is committed by parts of about ``per_commit`` samples, dealt by hash, so an
    interrupted run repeats one part at most; a part is read by itself, and goes to tasks by its rows, as scoring costs more
    than their bytes tell.  ``cap`` is that of ``relational.scored_within_cap``, which needs source_file and ord.
    """
    from ..session import stage
    from .relational import scored_within_cap

    samples = samples if cap is None else scored_within_cap(samples, cap)
    todo = progress.pending(samples, model)
    if (columns := getattr(scorer, "columns", None)) is not None:
        todo = todo.select("sample_id", *(c for c in columns if c != "sample_id"))
    todo = stage(todo, "pending")
    rows = todo.count()
    parts = max(1, -(-rows // per_commit))
    tasks = max(todo.sparkSession.sparkContext.defaultParallelism, -(-rows // (parts * TASK_ROWS)))
    if parts > 1:
        part = F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int")
        todo = stage(todo.withColumn("_part", part).repartition(parts, "_part"), "parts", "_part")
    for part in range(parts):
        some = todo.where(F.col("_part") == part).drop("_part") if parts > 1 else todo
        progress.add(score_batches(some.repartition(tasks, "sample_id"), scorer, batch), model)
    return progress.rows().where(F.col("model") == model)


def annotated_means(samples: DataFrame, progress) -> DataFrame:
    """Samples with the models' scores as a map, and their mean, rounded half to even."""
    from .relational import consolidate

    done = progress.rows().where("status = 'success'").select("sample_id", "model", "score", F.col("at").alias("ord"))
    return consolidate(samples, done)
