"""Figures of running work, the image listing as a data source, tensors, and verdicts over outputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgrade.operators import relational as R
from viewgrade.operators import scoring
from viewgrade.sources import image_listing
from viewgrade.streaming import observed, resume


def test_steps_of_a_run_are_counted_as_they_pass(spark, tmp_path):
    ticks = iter([0.0, 2.0, 8.0, 8.0])
    table = observed.RunTable(spark, f"{tmp_path}/figures")
    run = observed.Run(table, "r", 10, clock=lambda: next(ticks))
    work = spark.range(10).withColumn("error", F.when(F.col("id") % 4 == 0, "no"))
    run.step(work.where("id < 4"), lambda df: df.write.parquet(f"{tmp_path}/a"))
    run.step(work.where("id >= 4"), lambda df: df.write.parquet(f"{tmp_path}/b"))
    run.step(work.limit(0), lambda df: df.collect())
    got = [tuple(r)[1:] for r in table.rows().orderBy("step").collect()]
    assert got == [(0, 4, 1, 4, 10, 40.0, 2.0, 2.0, 3.0), (1, 6, 2, 10, 10, 100.0, 8.0, 1.25, 0.0), (2, 0, 0, 10, 10, 100.0, 8.0, 1.25, 0.0)]
    assert observed.figures(0, 0, 0, 5, 1.0)["eta"] == -1.0 and observed.figures(3, 0, 3, None, 1.0)["eta"] == -1.0 and observed.figures(0, 0, 0, 0, 0.0)["percent"] == 100.0


def test_batches_of_a_stream_leave_figures(spark, tmp_path):
    table = observed.RunTable(spark, f"{tmp_path}/figures")
    source = f"{tmp_path}/in"

    def run(total=None):
        return resume.score_stream(spark, source, "id long", scoring.ConstantScorer(0.5), f"{tmp_path}/out", f"{tmp_path}/check", table, total)

    spark.range(25).repartition(3).write.parquet(source)
    assert run(25) == 25 and run() == 0
    spark.range(7).write.mode("append").parquet(source)
    assert run(7) == 7
    got = table.rows().where("rows > 0").orderBy("step").collect()
    assert [(r.rows, r.errors, r.done, r.percent) for r in got] == [(25, 0, 25, 100.0), (7, 0, 7, 100.0)] and all(r.seconds > 0 and r.rate > 0 and r.eta == 0 for r in got)


def test_folders_are_pruned_before_they_are_opened(spark, tmp_path):
    for p in ("x.png", "a/x.JPG", "a/b/y.png", "a/noise/z.png", "noise/q.png", "c/w.jpeg", "c/t.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{p}"), exist_ok=True)
        with open(f"{tmp_path}/{p}", "wb") as f:
            f.write(b"123")
    found = lambda df: sorted((r.folder, r.name, r.extension, r.bytes) for r in df.collect())
    whole = image_listing.reference_images(spark, str(tmp_path), "multi_drone")
    assert found(whole) == [("", "x.png", "png", 3), ("a", "x.JPG", "jpg", 3), ("a", "y.png", "png", 3), ("c", "w.jpeg", "jpeg", 3)]
    assert len(found(image_listing.reference_images(spark, f"file://{tmp_path}"))) == 6
    os.chmod(f"{tmp_path}/c", 0)
    reader = image_listing.ImageReader(str(tmp_path), image_listing.NO_REFERENCE)
    left = list(reader.pushFilters([image_listing.EqualTo(("folder",), "a"), image_listing.In(("extension",), ("jpg", "gif")), image_listing.EqualTo(("name",), "n")]))
    assert [f.attribute for f in left] == [("name",)] and [p.name for p in reader.partitions()] == ["a"]
    one = whole.where("folder = 'a' AND extension = 'png'")
    assert found(one) == [("a", "y.png", "png", 3)] and one.rdd.getNumPartitions() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan viewgrade_images" in plan and "= a)" not in plan and "= png)" not in plan  # the reader has taken the filters
    os.chmod(f"{tmp_path}/c", 0o755)
    image_listing.register_layout("flat", ("a",))
    assert {r.folder for r in image_listing.reference_images(spark, str(tmp_path), "flat").collect()} == {"", "c", "noise"}
    with pytest.raises(ValueError, match="generic"):
        image_listing.reference_images(spark, str(tmp_path), "nothing")


class Counts:
    """Leaves a file whenever it is prepared."""

    def __init__(self, folder):
        self.folder = folder

    def prepare(self):
        with open(f"{self.folder}/{os.getpid()}-{np.random.default_rng().integers(1 << 60)}", "w"):
            pass

    def score(self, rows):
        return [float(np.sum(x)) + y for x, y in zip(rows["v"], rows["y"], strict=True)]


def test_a_model_is_prepared_once_in_a_worker(spark, tmp_path):
    rows = spark.range(400).select("id", F.array(*[F.col("id").cast("float")] * 6).alias("v"), F.lit(0.5).alias("y")).repartition(40)
    got = scoring.score_tensors(rows, Counts(str(tmp_path)), {"v": [2, 3], "y": None}, batch=5)
    assert {r.id: r.score for r in got.collect()} == {i: 6.0 * i + 0.5 for i in range(400)}
    assert 1 <= len(os.listdir(tmp_path)) == len({f.split("-")[0] for f in os.listdir(tmp_path)}) < 40


def test_verdict_of_outputs(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "source_file string, ord long, sample_id string")
    before = rows(("a", 0, "x"), ("a", 1, None), ("a", 2, "z"), ("b", 0, "p"), ("b", 1, "q"), ("b", 2, "r"), ("c", 0, "s"), ("e", 0, "t"), ("e", 1, "u"))
    after = rows(("a", 0, None), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "p"), ("b", 1, "r"), ("b", 2, "q"), ("d", 0, "s"), ("e", 0, "t"))
    assert {(r.source_file, r.fault, r.at) for r in R.file_faults(before, after).collect()} == {("b", "order", 1), ("c", "missing", None), ("d", "extra", None), ("e", "count", None)}
    assert tuple(R.output_verdict(before, after).first()) == (False, 4, 4, 7) and tuple(R.output_verdict(before, before).first()) == (True, 0, 4, 9)
    assert tuple(R.output_verdict(before.limit(0), before.limit(0)).first()) == (True, 0, 0, 0)
    assert {(r.source_file, r.ord, r.fault) for r in R.compare_outputs(before, after).collect()} == {("b", 1, "order"), ("b", 2, "order"), ("c", 0, "missing"), ("d", 0, "extra"), ("e", 1, "missing")}
