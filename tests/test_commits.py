"""Files that are replaced in commits, and the log of progress, with a stop after every step."""

import json
import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from viewgrade.operators import scoring
from viewgrade.sources import sinks


def contents(root):
    out = {}
    for name in ("a.json", "b/c.json", "d.json"):
        with open(f"{root}/{name}") as f:
            out[name] = {r["v"] for r in json.load(f)}
    return out


def test_a_stop_between_any_two_steps(spark, tmp_path, monkeypatch):
    """Each file is the old or the new one, whole, wherever the writer stops; the next writer finishes what was written down."""
    names = F.element_at(F.array(*map(F.lit, ("a.json", "b/c.json", "d.json"))), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(30).select(names.alias("source_file"), F.col("id").alias("ord"))
    put = lambda root, text: sinks.write_files(rows.withColumn("v", F.lit(text)), root)
    whole, seen = sinks._replace, set()
    for stop in range(5):
        root, steps = f"{tmp_path}/out{stop}", []
        put(root, "old")

        def once(s, old, new, steps=steps, stop=stop):
            steps.append(new)
            if len(steps) > stop:
                raise KeyboardInterrupt
            whole(s, old, new)

        monkeypatch.setattr(sinks, "_replace", once)
        try:
            put(root, "new")
        except KeyboardInterrupt:
            seen.add(stop)
        monkeypatch.setattr(sinks, "_replace", whole)
        now = contents(root)
        assert all(x in ({"old"}, {"new"}) for x in now.values()) and sum(x == {"new"} for x in now.values()) == max(0, stop - 1)
        sinks.recover(spark, root)
        assert set(map(tuple, contents(root).values())) == ({("old",)} if stop == 0 else {("new",)})
        assert not [x for x in os.listdir(root) if x.startswith(".staging")]
    assert seen == {0, 1, 2, 3}


def test_lost_bytes_are_found(spark, tmp_path, monkeypatch):
    rows = spark.range(9).select(F.lit("a.json").alias("source_file"), F.col("id").alias("ord"), F.lit("é😀").alias("v"))
    sinks.write_files(rows, str(tmp_path))
    kept = sinks.stage
    monkeypatch.setattr(sinks, "stage", lambda df, name: kept(df.withColumn("bytes", F.col("bytes") + 1), name))
    with pytest.raises(OSError, match="instead of"):
        sinks.write_files(rows.withColumn("v", F.lit("x")), str(tmp_path))
    with open(f"{tmp_path}/a.json") as f:
        assert [r["v"] for r in json.load(f)] == ["é😀"] * 9
    assert not [x for x in os.listdir(tmp_path) if x.startswith(".staging")]


def test_many_appends_are_one_snapshot_and_a_tail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TAIL", 4)
    progress, other = sinks.Progress(spark, f"{tmp_path}/p"), sinks.Progress(spark, f"{tmp_path}/p")
    some = lambda *ids: spark.createDataFrame([(f"s{i}",) for i in ids], "sample_id string")
    for k in range(11):
        (progress if k % 2 else other).add(some(k % 5).withColumn("score", F.lit(float(k))), "m")
        if k % 4 == 1:
            progress.add(some(7).withColumn("error", F.lit(f"e{k}")), "m")
    snapshot, tail = progress.tail()
    assert snapshot == 12 and tail == [13, 14] and progress._numbers("snapshot") == [8, 12] and progress._numbers("log")[0] > 8 - 4
    got = {r.sample_id: r for r in progress.rows().collect()}
    assert {i: got[f"s{i}"].score for i in range(5)} == {0: 10.0, 1: 6.0, 2: 7.0, 3: 8.0, 4: 9.0}
    assert got["s7"].status == "failed" and got["s7"].failures == 3 and got["s7"].error == "e9"
    paths = [f for f in progress.rows().inputFiles()]
    assert len({f.split("/p/")[1].rsplit("/", 1)[0] for f in paths}) <= 3  # a snapshot and two commits


def test_commits_have_an_order_without_clocks(spark, tmp_path, monkeypatch):
    """Two writers that take the same number: one goes on to the next, and the later commit counts."""
    a, b = sinks.Progress(spark, f"{tmp_path}/p"), sinks.Progress(spark, f"{tmp_path}/p")
    one = spark.createDataFrame([("s", 1.0)], "sample_id string, score double")
    a.add(one, "m")
    stale = b.tail()
    a.add(one.withColumn("score", F.lit(2.0)), "m")
    monkeypatch.setattr(b, "tail", lambda: stale)
    b.add(one.withColumn("score", F.lit(3.0)), "m")
    monkeypatch.undo()
    assert a._numbers("log") == [1, 2, 3] and a.rows().first().score == 3.0 and a.rows().first()["at"] == 3


def test_an_empty_log_has_no_states(spark, tmp_path):
    progress = sinks.Progress(spark, f"{tmp_path}/p")
    progress.compact()
    assert progress.rows().count() == 0 and progress.tail() == (None, [])


def test_scoring_is_dealt_by_rows_and_takes_the_columns_that_are_read(spark, tmp_path):
    class Place:
        columns = ["question"]

        def prepare(self):
            pass

        def score(self, rows):
            if list(rows.columns) != ["sample_id", "question"]:
                raise ValueError("other columns")
            return [float(TaskContext.get().partitionId())] * len(rows)

    samples = spark.range(200).select(F.col("id").cast("string").alias("sample_id"), F.lit("a b").alias("question"), F.lit(1).alias("level")).coalesce(1)
    for per in (1000, 50):
        progress = sinks.Progress(spark, f"{tmp_path}/{per}")
        scoring.annotate(samples, Place(), "m", progress, per_commit=per)
        rows = progress.rows().collect()
        assert len(rows) == 200 and {r.status for r in rows} == {"success"} and len({r.score for r in rows}) > 1
        assert len(progress.tail()[1]) == -(-200 // per)
