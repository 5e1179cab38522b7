"""Registered queries of images, their files and measures, and of the other files beside arrays of entries.

Images are drawn from rows of the given tables (``adapters.mosaic``), so that SQL can hold the exact distortions pixel by pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images as I
from ..session import run_folder
from ..sources import json_arrays as J
from ..sources import sinks
from ..sources.image_files import image_tensors, read_images, write_pngs
from . import adapters as A
from .registry import WITH, query

#: Distortions whose bytes follow from a pixel alone, as SQL of a channel {x} of r, g and b in [0, 1] and the intensity i.
GRAY_SQL = f"(r * {I.LUMA[0]}::DOUBLE + g * {I.LUMA[1]}::DOUBLE + b * {I.LUMA[2]}::DOUBLE)"
_BITS = "floor(log2(greatest(2, trunc(256 - 200 * i))))::INTEGER"
_BRIGHT, _DARK = "{x} + 0.05::DOUBLE + 0.45::DOUBLE * i", "{x} - 0.05::DOUBLE - 0.45::DOUBLE * i"
EXACT = {
    "brighten_max": _BRIGHT, "brighten_avg": _BRIGHT, "darken_max": _DARK, "darken_min": _DARK, "darken_avg": _DARK, "grayscale": GRAY_SQL,
    "color_shift": f"{GRAY_SQL} + ({{x}} - {GRAY_SQL}) * (1 + trunc(60 * i) / 100.0::DOUBLE)",
    "color_quantize": f"(trunc({{x}} * 255)::INTEGER & ((255 << (8 - {_BITS})) & 255)) / 255.0::DOUBLE",
}


def _written(channel: str) -> str:
    """A distorted channel as a byte."""
    cases = " ".join(f"WHEN '{n}' THEN {sql}" for n, sql in EXACT.items()).format(x=channel)
    return f"trunc(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE distortion {cases} END)) * 255)::INTEGER"


_NAMES = "(" + ", ".join(f"'{n}'" for n in EXACT) + ")"
_EXACT_SQL = f"""{WITH}, v AS (SELECT DISTINCT dataset, sequence_frame AS frame, distortion, uav AS view, level, level / 10.0::DOUBLE AS i FROM entries WHERE distortion IN {_NAMES}),
s AS ({A.squares_sql("v", "(dataset || '/' || frame || '/' || view)")}), f AS (SELECT *, r8 / 255.0::DOUBLE AS r, g8 / 255.0::DOUBLE AS g, b8 / 255.0::DOUBLE AS b FROM s),
o AS (SELECT *, {_written("r")} AS ro, {_written("g")} AS go, {_written("b")} AS bo FROM f),
l AS (SELECT dataset, frame, distortion, view, level, s // {A.SQUARES} AS line, string_agg(repeat(printf('%02x%02x%02x', ro, go, bo), {A.SQUARE}), '' ORDER BY s) AS pixels,
  sum((ro - r8) * (ro - r8) + (go - g8) * (go - g8) + (bo - b8) * (bo - b8)) * {A.SQUARE**2} AS e FROM o GROUP BY ALL)
SELECT dataset, frame, distortion, view, level, md5(unhex(string_agg(repeat(pixels, {A.SQUARE}), '' ORDER BY line))) AS pixels_md5, round(CASE WHEN sum(e) > 0 THEN 10 * log10(65025.0::DOUBLE / (sum(e) / {3.0 * A.SIDE**2}::DOUBLE)) END, 6)::DOUBLE AS psnr FROM l GROUP BY ALL"""


@query("exact_distortions", _EXACT_SQL)
def exact_distortions(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of the distortions that SQL can follow, at the entries' levels, and their PSNR."""
    views = A.views(spark, d, "level").where(F.col("distortion").isin(*EXACT))
    named = views.withColumns({"intensity": F.col("level") / 10, "kind": F.col("distortion"), "distortion": F.concat_ws("@", "distortion", "level")})
    scored = I.score_groups(named, {"psnr": I.METHODS["psnr"]}, A.SQUARE)
    psnr = F.when(~F.col("score").isin(float("inf")), F.round("score", 6))
    return scored.select("dataset", "frame", F.col("kind").alias("distortion"), "view", "level", "pixels_md5", psnr.alias("psnr"))


@query("distorted_views")
def distorted_views(spark: SparkSession, d: str) -> DataFrame:
    """Every frame, distortion and view of events at its group's picked intensity, by PSNR and SSIM (no SQL form)."""
    key = F.concat_ws("__", "dataset", "frame", "distortion")
    scored = I.score_groups(A.views(spark, d).withColumn("intensity", I.pick_intensity(key)), scale=A.SQUARE)
    return scored.select("dataset", "frame", "distortion", "view", "intensity", "pixels_md5", "method", F.round("score", 6).alias("score"), "error")


@query("distorted_catalogue")
def distorted_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every distortion at every level on the image of every supplier, mean PSNR and SSIM (no SQL form)."""
    cells = I.catalogue_sweep(A.portraits(spark, d)).groupBy("distortion", "intensity")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("psnr"), 6).alias("psnr"), F.round(F.avg("ssim"), 6).alias("ssim"))


@query("log_polar_features")
def log_polar_features(spark: SparkSession, d: str) -> DataFrame:
    """The log-polar spectrum of every supplier's image, by radius (no SQL form)."""
    rows = I.log_polar_features(A.portraits(spark, d)).select("name", F.posexplode("feature").alias("at", "v"))
    return rows.groupBy("name", F.floor(F.col("at") / 16).cast("int").alias("radius")).agg(F.round(F.sum("v"), 6).alias("magnitude"))


def _files(spark: SparkSession, d: str) -> str:
    """The suppliers' images as PNG files of a new folder, ten folders below it."""
    root = run_folder(spark, "images")
    name = F.concat_ws("/", F.pmod("name", F.lit(10)).cast("string"), F.concat(F.col("name").cast("string"), F.lit(".png")))
    failed = write_pngs(A.portraits(spark, d).withColumn("name", name), root).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} images could not be written")
    return root


_CHANNELS = " UNION ALL ".join(f"SELECT name, {k} AS channel, round(avg({c}8) / 255.0::DOUBLE, 6) AS mean, max({c}8) AS most FROM s GROUP BY 1" for k, c in enumerate("rgb"))


@query("file_tensors", f"WITH v AS (SELECT s_suppkey AS name FROM supplier), s AS ({A.squares_sql('v', chr(40) + chr(39) + 'supplier/' + chr(39) + ' || name)')}) {_CHANNELS}")
def file_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Images written as PNG files, decoded by the image source and resized to tensors, whose means and maxima by channel are shown."""
    tensors = image_tensors(read_images(spark, _files(spark, d), recursive=True), A.SIDE // 2)
    cells = (A.SIDE // 2) ** 2
    name = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long")
    each = tensors.select(name.alias("name"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.slice("tensor", k * cells + 1, cells))).alias("channel", "v"))
    shades = F.transform("v", lambda x: F.round(x * 255).cast("int"))  # whole again, as the image is halved within squares
    mean = F.aggregate(shades, F.lit(0), lambda x, y: x + y) / cells / 255
    return each.select("name", "channel", F.round(mean, 6).alias("mean"), F.array_max(shades).alias("most"))


@query("missing_images", WITH + " SELECT ord FROM entries WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'scene/' || s_suppkey = sequence_frame)")
def missing_images(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose image file isn't there."""
    number = F.substring_index("sequence_frame", "/", -1)
    path = F.concat_ws("/", F.pmod(number.cast("long"), F.lit(10)).cast("string"), F.concat(number, F.lit(".png")))
    return J.missing_files(A.entries(spark, d).withColumn("image", path), "image", _files(spark, d)).select("ord")


@query("manifest_faults", WITH + " SELECT * FROM (SELECT ord, concat_ws(', ', CASE WHEN uav = 1 THEN 'prompt is blank' END, CASE WHEN level = 2 OR level = 4 THEN 'reference is blank' END) AS faults FROM entries) WHERE faults <> ''")
def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the required texts that are null or blank."""
    c = F.col
    rows = A.entries(spark, d).select("ord", c("question_id").alias("sample"), F.when(c("uav") == 1, "  ").otherwise(c("question_type")).alias("prompt"), F.when(c("level") == 4, "").when(c("level") != 2, c("sequence_frame")).alias("reference"))
    return J.violations(rows, ("sample", "prompt", "reference")).select("ord", F.array_join("faults", ", ").alias("faults"))


def _model(key: str) -> Column:
    return A.choose(A.MODELS, A.pick("model", F.col(key), len(A.MODELS)))


_MODEL_SQL = A.choose_sql(A.MODELS, A.pick_sql("model", "ord", len(A.MODELS)))


@query("model_sidecars", f"{WITH} SELECT {_MODEL_SQL} AS model, split, ord AS sample_id, question_type AS prompt, score AS bleu FROM entries WHERE uav <> 3")
def model_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Details of models written below model and split, and read back with both from their path; files of other depth don't count."""
    e, c = A.entries(spark, d), F.col
    name = F.concat(c("dataset"), F.lit("_VQA_"), c("split"), F.lit(".json"))
    rows = e.select(F.when(c("uav") == 3, F.concat_ws("/", _model("ord"), name)).otherwise(F.concat_ws("/", _model("ord"), "split", name)).alias("source_file"), "ord", c("ord").cast("string").alias("sample_id"), c("question_type").alias("prompt"), c("score").alias("bleu"))
    root = run_folder(spark, "sidecars")
    sinks.write_files(rows, root)
    return J.sidecars(spark, root).select("model", "split", c("sample_id").cast("long").alias("sample_id"), "prompt", "bleu")


@query("annotation_notes", WITH + " SELECT dataset, ord AS sample_id, 'Good (' || level // 2 || '/5)' AS quality FROM entries WHERE uav = 1")
def annotation_notes(spark: SparkSession, d: str) -> DataFrame:
    """Records of files in Annotations folders, but of none that is named after VQA or lies elsewhere."""
    e, c = A.entries(spark, d), F.col
    file = F.when(c("uav") == 1, "Annotations/notes.json").when(c("uav") == 2, "Annotations/notes_VQA_1.json").otherwise("other/notes.json")
    rows = e.select(F.concat_ws("/", "dataset", file).alias("source_file"), "ord", c("dataset").alias("set"), c("ord").cast("string").alias("sample_id"), F.concat(F.lit("Good ("), F.floor(c("level") / 2).cast("string"), F.lit("/5)")).alias("Quality"))
    root = run_folder(spark, "notes")
    sinks.write_files(rows, root)
    return J.annotation_files(spark, root, "set string, sample_id string, Quality string").select(c("set").alias("dataset"), c("sample_id").cast("long").alias("sample_id"), c("Quality").alias("quality"))


@query("answers_of_both_sides", WITH + """, w AS (SELECT *, list_filter(string_split(question_type, ' '), lambda x: x <> '') AS words FROM entries)
SELECT ord, array_to_string(words, ' ') AS ref_answer, array_to_string(words[1:round_even(len(words) * (1 - level / 10.0::DOUBLE), 0)::INTEGER], ' ') AS dist_answer FROM w""")
def answers_of_both_sides(spark: SparkSession, d: str) -> DataFrame:
    """U4-U8: answers to a question for both images, the reference's once for each image and question."""
    from ..operators.scoring import EchoAnswers, score_with_references

    rows = A.entries(spark, d).select("ord", F.col("sequence_frame").alias("ref_image"), F.col("question_type").alias("question"), (F.col("level") / 10).alias("intensity"))
    return score_with_references(rows, EchoAnswers()).select("ord", "ref_answer", "dist_answer")
