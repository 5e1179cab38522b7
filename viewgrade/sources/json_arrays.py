"""JSON-array files as ordered rows (S1-S10, S18-S20), image listings (S11) and source adapters.

Files are read by byte ranges (``array_ranges``); ``ord`` is the record's place in its file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SAMPLES
from ..session import join_bounded
from .array_ranges import range_states, record_texts
from .image_listing import NO_REFERENCE


def _faulty() -> Column:
    """Is a row of ``record_texts`` a fault of its file?"""
    return F.col("fault") | (F.col("ord").isNotNull() & F.json_object_keys("value").isNull())


def read_arrays(spark: SparkSession, path: str | list[str], schema: str = SAMPLES, pattern: str = "*_VQA_*.json", recursive: bool = False, on_other: str = "raise") -> DataFrame:
    """source_file, ord and the records' fields.

    ``on_other``: what happens to a file that is no array of records: 'raise' when it is read, or 'skip'.
    """
    if on_other not in ("raise", "skip"):
        raise ValueError(on_other)
    texts = record_texts(spark, path, pattern, recursive)
    if on_other == "raise":
        told = F.raise_error(F.concat(F.lit("not a JSON array of records: "), "file_path")).cast("boolean")
        checked = texts.where(F.when(_faulty(), told).otherwise(F.col("ord").isNotNull()))
    else:
        bad = texts.where(_faulty()).select("file_path").distinct()
        checked = join_bounded(texts.where("ord IS NOT NULL"), bad, "file_path", "left_anti", 512)
    return _parsed(checked, schema)


def _parsed(texts: DataFrame, schema: str) -> DataFrame:
    rows = texts.select(F.col("file_path").alias("source_file"), F.col("ord").cast("int").alias("ord"), F.from_json("value", schema).alias("r"))
    return rows.select("source_file", "ord", "r.*")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, which sorts them as index files are read: files of the root before those of folders,
    training files before test files, then by name and record."""
    name = F.substring_index("source_file", "/", -1)
    kind = F.when(name.contains("_train"), 0).when(name.contains("_test"), 1).otherwise(2)
    depth = F.length("source_file") - F.length(F.replace("source_file", F.lit("/"), F.lit("")))
    return rows.withColumn("place", F.struct(depth.alias("depth"), kind.alias("kind"), F.col("source_file").alias("file"), F.col("ord").alias("ord")))


def _verdicts(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    """file_path, records, fault of every file."""
    return record_texts(spark, path, pattern, recursive).groupBy("file_path").agg(F.count("ord").cast("int").alias("records"), F.bool_or(_faulty()).alias("fault"))


def file_counts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file_path and number of records of every file (null where it is no array), at any depth, in order of path."""
    return _verdicts(spark, path, pattern, True).select("file_path", F.when(~F.col("fault"), F.col("records")).alias("records")).orderBy("file_path")


def validate_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """file_path, valid, count, warning."""
    ok = ~F.col("fault")
    return _verdicts(spark, path, pattern, False).select("file_path", ok.alias("valid"), F.when(ok, F.col("records")).otherwise(0).alias("count"), F.when(~ok, "Not a JSON array").alias("warning"))


def _bounds(size: int, file: str, start: int, end: int) -> None:
    if start < 0 or start > end or size < end:
        raise IndexError(f"chunk [{start}, {end}) is outside of {file}")


def chunk(rows: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """S5 of rows that are at hand: records start <= ord < end of one file; bounds outside the file are an error."""
    own = rows.where(F.col("source_file") == file)
    _bounds(own.count(), file, start, end)
    return own.where((F.col("ord") >= start) & (F.col("ord") < end))


def read_chunk(spark: SparkSession, file: str, start: int, end: int, schema: str = SAMPLES) -> DataFrame:
    """Records start <= ord < end of one file.

    No other file is opened, the bounds are held against the file's structure alone, and no other record is parsed.
    """
    of = range_states(spark, file, "*").select("records", "whole").first()
    if of is None or not of.whole:
        raise ValueError(f"not a JSON array of records: {file}")
    _bounds(of.records, file, start, end)
    texts = record_texts(spark, file, "*").where((F.col("ord") >= start) & (F.col("ord") < end))
    return _parsed(texts, schema)


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Model details under {root}/{model}/{split}/*.json, with model and split from the path; no other depth counts."""
    rows = read_arrays(spark, f"{root.rstrip('/')}/*/*/*.json", "sample_id string, prompt string, ref_answer string, dist_answer string, bleu double, rouge_l double, cider double", "*.json", on_other="skip")
    parts = F.split("source_file", "/")
    return rows.withColumn("model", F.try_element_at(parts, F.lit(-3))).withColumn("split", F.try_element_at(parts, F.lit(-2)))


def annotation_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records below any Annotations folder, but not from files named after VQA."""
    rows = read_arrays(spark, root, schema, "*.json", recursive=True, on_other="skip")
    return rows.where(F.col("source_file").rlike("/Annotations/[^/]*$") & ~F.col("source_file").rlike("VQA[^/]*$"))


def find_images(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Path of every jpg, jpeg or png below root, in order, unless a part of its path is excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.regexp_replace("path", r"^[^:]*:/*", "/")
    wanted = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    if excluded:
        base = len([x for x in root.split(":")[-1].split("/") if x])
        parts = F.filter(F.split(below, "/"), lambda x: x != "")
        wanted = wanted.where(~F.arrays_overlap(F.slice(parts, base + 1, F.greatest(F.size(parts) - base, F.lit(0))), F.array(*map(F.lit, excluded))))
    return wanted.orderBy("path")


#: Source adapters by name: (spark, root) -> paths of reference images.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_adapter(name: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        ADAPTERS[name] = f
        return f

    return keep


def adapter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


@register_adapter("multi_drone")
def _multi_drone(spark: SparkSession, root: str) -> DataFrame:
    return find_images(spark, root, NO_REFERENCE)


@register_adapter("generic")
def _generic(spark: SparkSession, root: str) -> DataFrame:
    return find_images(spark, root)


def violations(manifest: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows with a list of faults; rows are reported, never dropped."""
    faults = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} is blank")) for c in required]))
    return manifest.withColumn("faults", faults).where(F.size("faults") > 0)


def missing_files(manifest: DataFrame, column: str, root: str) -> DataFrame:
    """Rows whose path (relative to root) names no file below it; null paths are none's fault here."""
    files = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    clean = lambda x: F.regexp_replace(x, r"^[a-z]+:/*", "/")
    there = files.select(F.substring(clean(F.col("path")), F.length(F.concat(clean(F.lit(root.rstrip("/"))), F.lit("/"))) + 1, 1 << 20).alias("_there")).distinct()
    return manifest.where(F.col(column).isNotNull()).join(there, F.regexp_replace(F.col(column), "^(/|[.]/)+", "") == F.col("_there"), "left_anti")


def dataset_digest(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """16 hex digits over the files' own digests in order of path, so that no file leaves its task whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    per = files.select("path", F.sha2("content", 256).alias("digest"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x["digest"]), "")
    return per.agg(F.when(F.count(F.lit(1)) == 0, "").otherwise(F.substring(F.sha2(ordered.cast("binary"), 256), 1, 16)).alias("digest"))


def stream_digest(spark: SparkSession, path: str, pattern: str = "*.json", most: int = 1 << 30) -> str:
    """The first 16 hex digits of the SHA-256 of all files' bytes on end, training files first, then by path; "" without files.

    A digest of bytes on end has one order, so one task reads them, a file of at most 2 GB at a time.  A folder of more
    than ``most`` bytes is an error: ``dataset_digest`` has a digest for those.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    size = files.agg(F.sum("length").alias("n")).first().n
    if size is None:
        return ""
    if size > most:
        raise ValueError(f"{size} bytes are more than {most}; use dataset_digest")
    name = F.substring_index("path", "/", -1)
    kind = F.when(name.contains("_train"), 0).when(name.contains("_test"), 1).otherwise(2)

    def run(batches):
        whole = hashlib.sha256()
        for batch in batches:
            for content in batch.column("content"):
                whole.update(content.as_buffer())
        yield pa.RecordBatch.from_pydict({"digest": [whole.hexdigest()[:16]]})

    ordered = files.select("content", kind.alias("kind"), "path").repartition(1).sortWithinPartitions("kind", "path").select("content")
    return ordered.mapInArrow(run, "digest string").first().digest
