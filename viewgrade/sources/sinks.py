"""Ordered JSON-array output (K1-K7, K9, K10) and the resumable progress table.

Records of one output file are formatted by all tasks and written in order by one, as the format asks for one array per file;
they stream through that task, which holds none of them.  Files replace older ones in a commit that can be taken up again
(``recover``).  Everything larger stays in Parquet.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, stage


def _fs(spark: SparkSession, path: str) -> tuple:
    """Hadoop path and file system of a path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, old: str, new: str) -> None:
    """Move a file onto another place in one step, whatever is there."""
    source, fs = _fs(spark, old)
    target, _ = _fs(spark, new)
    if source.toUri().getScheme() in ("file", None) and fs.getUri().getScheme() == "file":  # a folder of the driver's, where a rename replaces
        place = target.toUri().getPath()
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(os.path.dirname(place), f".{os.path.basename(place)}.crc"))  # the older file's checksum
        os.replace(source.toUri().getPath(), place)
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all."""
    place, fs = _fs(spark, f"{path}.part")
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(spark, f"{path}.part", path)


STAGING, MANIFEST = ".staging-", "commit.json"


def _finish(spark: SparkSession, staging: str) -> None:
    """Move what a manifest lists to its places; what is there already was moved before."""
    folder, fs = _fs(spark, staging)
    place, _ = _fs(spark, f"{staging}/{MANIFEST}")
    stream = fs.open(place)
    moves = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    stream.close()
    for part, target in moves:
        source, _ = _fs(spark, part)
        if fs.exists(source):
            fs.mkdirs(_fs(spark, target)[0].getParent())
            _replace(spark, part, target)
    fs.delete(folder, True)


def recover(spark: SparkSession, root: str) -> None:
    """What interrupted writers left below root: a commit that had begun is finished, anything else is removed.

    For one writer at a time; ``write_files`` begins with it.
    """
    folder, fs = _fs(spark, root)
    if not fs.exists(folder):
        return
    for place in [s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith(STAGING)]:
        if fs.exists(_fs(spark, f"{place}/{MANIFEST}")[0]):
            _finish(spark, place)
        else:
            fs.delete(_fs(spark, place)[0], True)


def write_files(rows: DataFrame, root: str, expected: dict[str, int] | None = None, order: str = "ord", drop: tuple[str, ...] = ("source_file", "ord"), names: tuple[str, ...] = ()) -> list[str]:
    """K4, K5: one array per source_file, at the same relative name below root; a wrong count is an error.

    One job writes all files: rows are dealt by file, sorted, and written as lines between a line for each bracket.
    Places (``order``) are unique in a file and not negative.  ``names`` without rows become empty arrays.

    Until the job is done nothing at the files' places changes.  The commit holds the bytes of each file against those that
    its rows have, writes down what it is to move, and moves file by file, each in one step; so whenever a writer stops, a
    place has its old or its new file, and the next writer, or ``recover``, finishes a commit that was written down.
    """
    spark = rows.sparkSession
    recover(spark, root)
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in drop]), {"ignoreNullFields": "false"})
    texts = rows.select("source_file", F.col(order).cast("long").alias("_at"), body.alias("value"))
    sizes = texts.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.sum(F.octet_length("value") + 2).alias("bytes"))
    sizes = stage(sizes, "sizes")
    counts = {r.source_file: (r.n, r.bytes) for r in sizes.select("source_file", "n", "bytes").collect()}  # one row per output file
    for name, n in (expected or {}).items():
        if counts.get(name, (0,))[0] != n:
            raise ValueError(f"{name}: {counts.get(name, (0,))[0]} records instead of {n}")
    lines = texts.join(sizes.select("source_file", "first"), "source_file")
    lines = lines.select("source_file", "_at", F.when(F.col("_at") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    empty = spark.createDataFrame([(n,) for n in names if n not in counts], "source_file string")
    brackets = sizes.select("source_file").unionByName(empty).select("source_file", F.inline(F.array(*[F.struct(F.lit(at).cast("long").alias("_at"), F.lit(mark).alias("value")) for at, mark in ((-1, "["), ((1 << 63) - 1, "]"))])))
    staging = f"{root}/{STAGING}{uuid.uuid4().hex}"
    ordered = lines.unionByName(brackets).repartition("source_file").sortWithinPartitions("source_file", "_at")
    ordered.drop("_at").write.partitionBy("source_file").text(staging)
    folder, fs = _fs(spark, staging)
    moves = []
    for place in [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]:
        name = unquote(place.getName().split("=", 1)[1])
        parts = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(place)]
        # two bytes of a line beside its record: a comma but for the first, and the line's end; and a line for each bracket
        bytes_ = 4 + (counts[name][1] - 1 if name in counts else 0)
        if len(parts) != 1 or parts[0][1] != bytes_:
            fs.delete(folder, True)
            raise OSError(f"{name}: files and bytes {[n for _, n in parts]} instead of one of {bytes_}")
        moves.append((parts[0][0], f"{root}/{name}"))
    _put(spark, f"{staging}/{MANIFEST}", json.dumps(moves))
    _finish(spark, staging)
    return sorted({*counts, *names})


def write_array(rows: DataFrame, order: list[str], path: str, drop: tuple[str, ...] = ("source_file", "ord")) -> None:
    """K1, K2, K7: one JSON array in the given order; the file is replaced as a whole."""
    root, name = path.rsplit("/", 1)
    kept = [c for c in rows.columns if c not in drop]
    # places by range, so that only the writing task sees all rows, and those as a stream
    sorted_ = rows.orderBy(*order).select(F.monotonically_increasing_id().alias("_place"), *[F.col(c) for c in kept])
    write_files(sorted_.select("_place", *kept, F.lit(name).alias("source_file")), root, order="_place", drop=("source_file", "_place"), names=(name,))


def latex_table(rows: DataFrame, columns: dict[str, str], order: list[str], caption: str = "", label: str = "", most: int = 500) -> str:
    """A printed table as LaTeX text; ``columns`` are headings by column.  A table of more than ``most`` lines is an error."""
    found = rows.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a printed table has {most} lines at most")
    special = {c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    text = lambda v: "---" if v is None else "".join(special.get(c, c) for c in (f"{v:.4f}" if isinstance(v, float) else str(v)))
    line = lambda cells: " & ".join(cells) + r" \\"
    numbers = {f.name for f in rows.schema if f.dataType.typeName() not in ("string", "boolean")}
    body = [r"\toprule", line([rf"\textbf{{{text(h)}}}" for h in columns.values()]), r"\midrule", *(line([text(r[c]) for c in columns]) for r in found), r"\bottomrule"]
    inner = [rf"\begin{{tabular}}{{{''.join('r' if c in numbers else 'l' for c in columns)}}}", *body, r"\end{tabular}"]
    head = [r"\centering", *([rf"\caption{{{text(caption)}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else [])]
    return "\n".join([r"\begin{table}[t]", *head, *inner, r"\end{table}"]) + "\n"


def split_details(scored: DataFrame, details: str = "model_details") -> tuple[DataFrame, DataFrame]:
    """Main rows without their details, and one detail row per sample and model."""
    side = scored.select("source_file", "ord", "sample_id", F.explode(details).alias("model", "d")).select("source_file", "ord", "sample_id", "model", "d.*")
    return scored.drop(details), side


def split_metrics(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two metric frames of ``scoring.truth_similarity``: metric 1 with its raw figures, and metric 2."""
    keep = [c for c in scored.columns if not c.startswith(("metric1", "metric2", "raw_"))]
    one = [c for c in scored.columns if c.startswith(("metric1", "raw_"))]
    return scored.select(*keep, *one), scored.select(*keep, *[c for c in scored.columns if c.startswith("metric2")])


#: Commits after a snapshot at which the next one is made.
TAIL = 16


class Progress:
    """States of (sample_id, model) pairs as a log with snapshots (S21, C2, C10, C12, K13); the latest state counts.

    A commit is a folder ``log/<n>`` that appears by one rename; n is one more than the last commit's, and a writer that finds
    its number taken goes on to the next, so commits have an order without clocks.  ``snapshot/<n>`` holds the latest states of
    all commits up to n: a reader takes the last snapshot and the commits after it.  After ``TAIL`` of those the writer makes a
    snapshot, and commits that an older one covers go.  A crash loses at most what was being appended, and replays are harmless.
    """

    SCHEMA = "sample_id string, model string, status string, score double, error string"
    STATES = f"{SCHEMA}, at long, failures int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        folder, fs = _fs(self.spark, f"{self.path}/{kind}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _append(self, rows: DataFrame, kind: str, number: int) -> int:
        """Write rows aside, then give them the first free number from ``number``."""
        aside = f"{self.path}/.new-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        source, fs = _fs(self.spark, aside)
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        fs.mkdirs(_fs(self.spark, f"{self.path}/{kind}")[0])
        while True:
            target, _ = _fs(self.spark, f"{self.path}/{kind}/{number:012d}")
            try:
                files.rename(source, target, none)
                return number
            except Py4JJavaError:
                if not fs.exists(target):
                    raise
                number += 1

    def tail(self) -> tuple[int | None, list[int]]:
        """The last snapshot's number, and those of the commits after it."""
        snapshots = self._numbers("snapshot")
        last = snapshots[-1] if snapshots else None
        return last, [n for n in self._numbers("log") if last is None or n > last]

    def rows(self) -> DataFrame:
        """The latest state of each pair, the number of its commit (``at``), and how often the pair failed."""
        snapshot, tail = self.tail()
        found = self.spark.createDataFrame([], self.STATES)
        if snapshot is not None:
            found = self.spark.read.schema(self.STATES).parquet(f"{self.path}/snapshot/{snapshot:012d}")
        if tail:
            new = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/log/{n:012d}" for n in tail])
            at = F.regexp_extract("_metadata.file_path", r"/log/(\d+)/[^/]*$", 1).cast("long")
            found = found.unionByName(new.select("*", at.alias("at"), (F.col("status") == "failed").cast("int").alias("failures")))
        last = F.max(F.struct("at", "status", "score", "error"))
        return found.groupBy("sample_id", "model").agg(last.alias("_s"), F.sum("failures").cast("int").alias("failures")).select("sample_id", "model", "_s.status", "_s.score", "_s.error", "_s.at", "failures")

    def _commit(self, rows: DataFrame) -> None:
        snapshot, tail = self.tail()
        self._append(rows, "log", max([snapshot or 0, *tail]) + 1)
        if len(tail) + 1 >= TAIL:
            self.compact()

    def compact(self) -> None:
        """Merge snapshot and tail into a snapshot; what the snapshot before covered isn't read any more and goes."""
        snapshot, tail = self.tail()
        if not tail:
            return
        self._append(self.rows(), "snapshot", tail[-1])
        for kind, old in (("log", [n for n in self._numbers("log") if snapshot is not None and n <= snapshot]), ("snapshot", [n for n in self._numbers("snapshot") if snapshot is not None and n < snapshot])):
            for n in old:
                remove(self.spark, f"{self.path}/{kind}/{n:012d}")

    def pending(self, samples: DataFrame, model: str, most_failures: int | None = None) -> DataFrame:
        """Samples without a success of the model; with ``most_failures``, also not those that failed as often."""
        done = F.col("status") == "success"
        if most_failures is not None:
            done = done | (F.col("failures") >= most_failures)
        return samples.join(self.rows().where((F.col("model") == model) & done).select("sample_id"), "sample_id", "left_anti")

    def add(self, scored: DataFrame, model: str, status: str = "success") -> None:
        """Append states: those with an ``error`` are failures."""
        error = F.col("error").cast("string") if "error" in scored.columns else F.lit(None).cast("string")
        state = F.when(error.isNotNull(), "failed").otherwise(status)
        score = F.col("score").cast("double") if "score" in scored.columns else F.lit(None).cast("double")
        self._commit(scored.select("sample_id", F.lit(model).alias("model"), state.alias("status"), score.alias("score"), error.alias("error")))

    def counts(self) -> DataFrame:
        return self.rows().groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))

    def reset(self, bad: DataFrame, model: str | None = None) -> None:
        """Mark samples failed (of one model, or of all), so that they are pending again."""
        hit = self.rows().where(F.lit(True) if model is None else F.col("model") == model).join(bad.select("sample_id").distinct(), "sample_id", "left_semi")
        self._commit(hit.select("sample_id", "model", F.lit("failed").alias("status"), F.lit(None).cast("double").alias("score"), F.lit("reset").alias("error")))
