"""Image files in and out.

JPEG, PNG, BMP and GIF files are decoded by Spark's image source, in the JVM; PNG files are written by the tasks that
hold the images, through the file system that the path names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructType

from ..functions.images import resize


@F.pandas_udf(BinaryType())
def rgb_bytes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Pixels of the image source (blue, green, red, perhaps alpha, or gray) as RGB bytes, row by row."""
    for data, channels in batches:
        out = []
        for pixels, n in zip(data, channels, strict=True):
            x = np.frombuffer(pixels, np.uint8).reshape(-1, int(n))
            out.append((x[:, [2, 1, 0]] if n >= 3 else np.repeat(x, 3, axis=1)).tobytes())
        yield pd.Series(out)


def read_images(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Path, h, w, image (RGB bytes), error.  A file that is no image has an error and nulls."""
    files = spark.read.format("image").option("recursiveFileLookup", recursive).load(path).select("image.*")
    fine = F.col("height") > 0
    return files.select(F.col("origin").alias("path"), F.when(fine, F.col("height")).alias("h"), F.when(fine, F.col("width")).alias("w"), F.when(fine, rgb_bytes(F.when(fine, F.col("data")).otherwise(F.lit(b"")), F.when(fine, F.col("nChannels")).otherwise(F.lit(3)))).alias("image"), F.when(~fine, F.lit("cannot read image")).alias("error"))


def image_tensors(images: DataFrame, size: int = 256) -> DataFrame:
    """Rows with ``tensor``, floats in [0, 1] by channel, row and column of the image resized to a square."""
    schema = StructType([*images.schema.fields]).add("tensor", ArrayType(FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = None if r.image is None else np.frombuffer(r.image, np.uint8).reshape(int(r.h), int(r.w), 3).astype(np.float64) / 255
                out.append(None if x is None else resize(x, size, size).transpose(2, 0, 1).ravel().astype(np.float32))
            yield pdf.assign(tensor=out)

    return images.mapInPandas(run, schema)


def png(image: bytes, h: int, w: int) -> bytes:
    """A PNG file of RGB bytes."""
    rows = np.frombuffer(image, np.uint8).reshape(h, 3 * w)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()  # every line unfiltered

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def write_pngs(images: DataFrame, root: str, name: str = "name", image: str = "image") -> DataFrame:
    """K8: write every image (with h, w) as PNG at its relative name below root; name and error of each.

    The files are written when the result is evaluated.  A file appears by rename, so that a repeated task does no
    harm; a row that fails has an error, and the others go on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pyarrow.fs.LocalFileSystem(), root)
        for pdf in batches:
            errors = []
            for r in pdf.itertuples():
                try:
                    target = f"{base}/{r.name_}"
                    if ".." in str(r.name_).split("/"):
                        raise ValueError("the name leaves its root")
                    data = png(r.image_, int(r.h), int(r.w))
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(f"{target}.part") as f:
                        f.write(data)
                    fs.move(f"{target}.part", target)
                    errors.append(None)
                except (ValueError, TypeError, OSError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"name": pdf["name_"], "error": errors})

    return images.select(F.col(name).alias("name_"), F.col(image).alias("image_"), "h", "w").mapInPandas(run, "name string, error string")


def distort_folder(spark: SparkSession, source: str, target: str, cells: list[tuple[str, float, int]]) -> DataFrame:
    """The whole flow in one job: a folder of image files goes in, distorted PNGs come out.

    ``cells``: (distortion, intensity, seed) that every image goes through, a part of the catalogue.  A frame is a file's folder and a view its name; files are called
    ``frame__distortion_Lnn/view.png`` below target.  Returns name and error of each.
    """
    from ..functions.images import distort_groups

    images = read_images(spark, source, recursive=True)
    below = F.split(F.regexp_replace("path", r"^[^:]*:/*", "/"), "/")
    frame, view = F.element_at(below, -2), F.regexp_replace(F.element_at(below, -1), r"\.[^.]*$", "")
    grid = F.array(*[F.struct(F.lit(n).alias("distortion"), F.lit(float(i)).alias("intensity"), F.lit(int(s)).cast("long").alias("seed")) for n, i, s in cells])
    rows = images.select(F.lit("images").alias("dataset"), frame.alias("frame"), view.alias("view"), "image", "h", "w", F.inline(grid))
    rows = rows.withColumn("distortion", F.concat_ws("@", "distortion", "intensity"))
    done = distort_groups(rows)
    level = F.lpad(F.floor(F.col("intensity") * 10).cast("string"), 2, "0")
    name = F.concat("frame", F.lit("__"), F.substring_index("distortion", "@", 1), F.lit("_L"), level, F.lit("/"), "view", F.lit(".png"))
    written = write_pngs(done.where("error is null").withColumn("name", name), target, image="distorted")
    return written.unionByName(done.where("error is not null").select(name.alias("name"), "error"))
