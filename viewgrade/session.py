"""A session with the settings the engine is written for, and the folder that its executors share."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times the declared row width stay under this many bytes.
BROADCAST_BYTES = 32 << 20


def build_session(name: str = "viewgrade", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode, else an error."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "viewgrade-scratch")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join; broadcast ``right`` only if its counted size fits ``BROADCAST_BYTES``, else shuffle both sides."""
    return left.join(F.broadcast(right) if right.count() * row_bytes <= BROADCAST_BYTES else right.hint("merge"), on, how)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; what is written there goes with the driver's JVM."""
    root = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)  # a folder that isn't there yet can't be marked
    fs.deleteOnExit(hadoop)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder (in folders of its last column ``by``) and read it back: what is dealt to
    partitions stays as it was, and a lost executor costs no more than a file."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
