"""Sources, sinks, progress, scoring, streaming and the registered queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from viewgrade.operators import relational as R
from viewgrade.operators import scoring
from viewgrade.sources import json_arrays as J
from viewgrade.sources import sinks
from viewgrade.streaming import resume

SMALL = "sample_id string, question string, uav_paths map<string,string>, options string"


def dump(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f)


@pytest.fixture()
def folder(tmp_path):
    a = [{"sample_id": f"a{i}", "question": "what é", "uav_paths": {"UAV2": "y", "UAV1": "x"}, "options": {"A": "UAV1"}} for i in range(10)]
    b = [{"sample_id": f"b{i}", "question": None, "options": []} for i in range(25)]
    dump(f"{tmp_path}/train/Sim3_VQA_train.json", a)
    dump(f"{tmp_path}/train/Real2_VQA_train.json", b)
    return str(tmp_path)


def test_arrays_keep_order_and_schema(spark, folder):
    rows = J.read_arrays(spark, f"{folder}/train", SMALL)
    got = rows.orderBy("source_file", "ord").collect()
    assert [r.sample_id for r in got] == [f"b{i}" for i in range(25)] + [f"a{i}" for i in range(10)]
    assert got[-1].uav_paths == {"UAV1": "x", "UAV2": "y"} and json.loads(got[-1].options) == {"A": "UAV1"} and got[0].options == "[]"
    assert [(r.file_path.rsplit("/", 1)[1], r.records) for r in J.file_counts(spark, folder).collect()] == [("Real2_VQA_train.json", 25), ("Sim3_VQA_train.json", 10)]


def test_other_json_is_refused_or_skipped(spark, folder):
    dump(f"{folder}/train/Bad_VQA_train.json", {"sample_id": "z"})
    with pytest.raises(Exception, match="not a JSON array"):
        J.read_arrays(spark, f"{folder}/train", SMALL).collect()
    assert J.read_arrays(spark, f"{folder}/train", SMALL, on_other="skip").count() == 35
    assert {r.file_path.rsplit("/", 1)[1]: r.valid for r in J.validate_files(spark, f"{folder}/train").collect()}["Bad_VQA_train.json"] is False
    with pytest.raises(ValueError):
        J.read_arrays(spark, folder, SMALL, on_other="guess")


def test_chunks(spark, folder):
    rows = J.read_arrays(spark, f"{folder}/train", SMALL)
    name = [r.source_file for r in rows.select("source_file").distinct().collect() if "Real2" in r.source_file][0]
    assert [r.sample_id for r in J.chunk(rows, name, 20, 25).orderBy("ord").collect()] == [f"b{i}" for i in range(20, 25)]
    for bounds in ((-1, 2), (3, 2), (20, 26)):
        with pytest.raises(IndexError):
            J.chunk(rows, name, *bounds)


def test_images_and_adapters(spark, tmp_path):
    for p in ("a/x.JPG", "a/y.png", "noise/z.jpg", "b/Annotations/w.jpeg", "b/t.txt"):
        os.makedirs(f"{tmp_path}/{os.path.dirname(p)}", exist_ok=True)
        with open(f"{tmp_path}/{p}", "wb") as f:
            f.write(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(J.adapter("generic")(spark, str(tmp_path))) == ["x.JPG", "y.png", "w.jpeg", "z.jpg"]
    assert names(J.adapter("multi_drone")(spark, str(tmp_path))) == ["x.JPG", "y.png"]
    with pytest.raises(ValueError, match="generic"):
        J.adapter("nothing")


def test_ordered_output(spark, folder, tmp_path):
    rows = J.read_arrays(spark, f"{folder}/train", SMALL).withColumn("source_file", F.substring_index("source_file", "/", -1))
    out = f"{tmp_path}/out"
    assert sinks.write_files(rows.repartition(4), out) == ["Real2_VQA_train.json", "Sim3_VQA_train.json"]
    with open(f"{out}/Sim3_VQA_train.json") as f:
        assert [r["sample_id"] for r in json.load(f)] == [f"a{i}" for i in range(10)]
    back = J.read_arrays(spark, out, SMALL).withColumn("source_file", F.substring_index("source_file", "/", -1))
    assert R.compare_outputs(rows, back).count() == 0
    assert {r.fault for r in R.compare_outputs(rows, back.where("ord <> 3")).collect()} == {"missing"}
    with pytest.raises(ValueError):
        sinks.write_files(rows, out, {"Sim3_VQA_train.json": 11})


def test_progress_and_annotation(spark, tmp_path):
    samples = spark.createDataFrame([(f"s{i}", "why so") for i in range(12)], "sample_id string, question string")
    progress = sinks.Progress(spark, f"{tmp_path}/progress")
    assert progress.rows().count() == 0 and progress.pending(samples, "m").count() == 12
    assert scoring.annotate(samples, scoring.ConstantScorer(0.25), "m", progress).count() == 12
    assert progress.pending(samples, "m").count() == 0 and progress.pending(samples, "other").count() == 12
    progress.reset(samples.limit(3))
    assert progress.pending(samples, "m").count() == 3
    assert {tuple(r) for r in progress.counts().collect()} == {("m", "success", 9), ("m", "failed", 3)}
    assert progress.pending(samples, "m", most_failures=1).count() == 0
    assert scoring.annotate(samples, scoring.ConstantScorer(0.5), "m", progress).where("score = 0.5").count() == 3 and progress.pending(samples, "m").count() == 0


def test_an_interrupted_run_keeps_its_commits(spark, tmp_path):
    class Breaks(sinks.Progress):
        commits = 0

        def add(self, scored, model, status="success"):
            self.commits += 1
            if self.commits == 3:
                raise RuntimeError("lost")
            super().add(scored, model, status)

    samples = spark.createDataFrame([(f"s{i}", "why") for i in range(60)], "sample_id string, question string")
    progress = Breaks(spark, f"{tmp_path}/progress")
    with pytest.raises(RuntimeError):
        scoring.annotate(samples, scoring.ConstantScorer(1.0), "m", progress, per_commit=12)
    left = progress.pending(samples, "m").count()
    assert progress.commits == 3 and 0 < left < 50 and left + progress.rows().count() == 60
    assert scoring.annotate(samples, scoring.ConstantScorer(1.0), "m", progress, per_commit=12).count() == 60


def test_failures_are_recorded_and_means_are_rounded_half_to_even(spark, tmp_path):
    samples = spark.createDataFrame([(f"s{i}", "q", None, None) for i in range(9)], "sample_id string, question string, vlm_scores map<string,double>, cognitive_score double")
    progress = sinks.Progress(spark, f"{tmp_path}/progress")
    got = {r.sample_id: r for r in scoring.annotate(samples.select("sample_id", "question"), Picky(), "m", progress).collect()}
    assert got["s3"].status == "failed" and "no picture" in got["s3"].error and got["s3"].failures == 1 and got["s4"].score == 1.0
    progress.add(samples.select("sample_id", F.lit(0.000001).alias("score")), "n")
    assert {r.sample_id: r.cognitive_score for r in scoring.annotated_means(samples, progress).collect()} == {f"s{i}": 0.000001 if i == 3 else 0.5 for i in range(9)}


def test_files_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    out, rows = f"{tmp_path}/out", spark.range(5000).select(F.concat(F.lit("a/f "), F.col("id") % 7, F.lit("=%.json")).alias("source_file"), F.floor(F.col("id") / 7).alias("ord"), F.col("id").alias("v"), F.lit("é\n,]").alias("t"))
    names = sinks.write_files(rows.repartition(9), out, names=("b.json",))
    assert names == [*[f"a/f {i}=%.json" for i in range(7)], "b.json"] and sorted(x for x in os.listdir(out) if x[0] != "." or "staging" in x) == ["a", "b.json"]
    for i in range(7):
        with open(f"{out}/a/f {i}=%.json") as f:
            assert json.load(f) == [{"v": v, "t": "é\n,]"} for v in range(i, 5000, 7)]
    with open(f"{out}/b.json") as f:
        assert json.load(f) == []
    with pytest.raises(Exception):  # noqa: B017  the job fails, and the old files stay
        sinks.write_files(rows.withColumn("t", F.when(F.col("v") == 4999, F.raise_error(F.lit("lost"))).otherwise(F.lit("new"))), out)
    with open(f"{out}/a/f 0=%.json") as f:
        assert json.load(f)[0]["t"] == "é\n,]"
    sinks.write_array(rows.where("v < 50").repartition(3), ["v"], f"{out}/c.json")
    with open(f"{out}/c.json") as f:
        assert [r["v"] for r in json.load(f)] == list(range(50))


def test_scratch_folder_is_shared(spark):
    from viewgrade.session import shared_dir

    class Other:
        def __init__(self, conf):
            self.conf = conf
            self.sparkContext = self

        def getConf(self):
            return self.conf

    assert shared_dir(Other({"spark.checkpoint.dir": "x://y/", "spark.master": "yarn"})) == "x://y"
    assert "viewgrade" in shared_dir(Other({"spark.master": "local[2]"}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Other({"spark.master": "spark://host"}))


def test_images_go_in_and_distorted_ones_come_out(spark, tmp_path):
    from viewgrade.functions import images
    from viewgrade.sources import image_files as I

    one, two = images.test_image(40), images.test_image(32)[:, ::-1].copy()
    rows = spark.createDataFrame([("s1/UAV1.png", one.tobytes(), 40, 40), ("s1/UAV2.png", two.tobytes(), 32, 32), ("../x.png", b"", 1, 1), ("bad.png", b"xyz", 5, 5)], "name string, image binary, h int, w int")
    errors = {r.name: r.error for r in I.write_pngs(rows, f"{tmp_path}/in").collect()}
    assert errors["s1/UAV1.png"] is None and "root" in errors["../x.png"] and errors["bad.png"] and not os.path.exists(f"{tmp_path}/x.png")
    with open(f"{tmp_path}/in/s1/no.png", "wb") as f:
        f.write(b"no image")
    got = {r.path.rsplit("/", 1)[1]: r for r in I.read_images(spark, f"{tmp_path}/in", recursive=True).collect()}
    assert bytes(got["UAV1.png"].image) == one.tobytes() and bytes(got["UAV2.png"].image) == two.tobytes() and (got["UAV2.png"].h, got["UAV2.png"].w) == (32, 32)
    assert got["no.png"].image is None and got["no.png"].error
    tensor = {r.path.rsplit("/", 1)[1]: r.tensor for r in I.image_tensors(I.read_images(spark, f"{tmp_path}/in", recursive=True), 20).collect()}
    assert len(tensor["UAV1.png"]) == 1200 and 0 <= min(tensor["UAV1.png"]) <= max(tensor["UAV1.png"]) <= 1 and tensor["no.png"] is None
    done = {r.name: r.error for r in I.distort_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", [("white_noise", 0.6, 5), ("grayscale", 1.0, 1), ("nothing", 1.0, 1)]).collect()}
    assert len(done) == 9 and {k for k, v in done.items() if v is None} == {f"s1__{x}/{v}.png" for x in ("white_noise_L06", "grayscale_L10") for v in ("UAV1", "UAV2")}
    back = {r.path.rsplit("/", 2)[1:][0] + "/" + r.path.rsplit("/", 1)[1]: bytes(r.image) for r in I.read_images(spark, f"{tmp_path}/out", recursive=True).collect()}
    tool = images.Distorter("white_noise", 5)
    assert back["s1__white_noise_L06/UAV1.png"] == tool.apply(one, 0.6).tobytes()
    scored = images.score_methods(spark.createDataFrame([(1, one.tobytes(), one.tobytes(), 40, 40, 40, 40), (2, one.tobytes(), None, 40, 40, None, None), (3, one.tobytes(), two.tobytes(), 40, 40, 32, 32), (4, None, None, 1, 1, 1, 1)], "id int, image binary, ref binary, h int, w int, ref_h int, ref_w int"))
    seen = {(r.id, r.method): r for r in scored.collect()}
    assert seen[1, "psnr"].score == float("inf") and abs(seen[1, "ssim"].score - 1) < 1e-12 and seen[2, "psnr"].score == seen[2, "ssim"].score == 0.0
    assert 0 < seen[3, "psnr"].score < 30 and seen[3, "ssim"].score < 1 and seen[4, "ssim"].error and len(seen) == 8


def test_roles_states_and_policies(spark):
    samples = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    assert sorted((r.id, r.role) for r in R.split_rows(samples, "fit").collect()) == [(1, "train"), (2, "test"), (2, "validate")]
    assert [(r.id, r.role) for r in R.split_rows(samples, "test").collect()] == [(2, "test")]
    one = spark.range(1)
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))
    assert one.select(R.paired(a, b, "null")).first()[0] is None and len(one.select(R.paired(a, a, "raise")).first()[0]) == 2
    with pytest.raises(Exception, match="lists of 2 and 1"):
        one.select(R.paired(a, b, "raise")).collect()
    with pytest.raises(ValueError):
        R.paired(a, b, "guess")


class Picky:
    def prepare(self):
        pass

    def score(self, rows):
        if (rows["sample_id"] == "s3").any():
            raise RuntimeError("no picture")
        return [1.0] * len(rows)


def test_a_failing_row_stays_alone(spark):
    samples = spark.createDataFrame([(f"s{i}", "q") for i in range(9)], "sample_id string, question string").coalesce(1)
    got = {r.sample_id: r for r in scoring.score_batches(samples, Picky(), batch=4).collect()}
    assert [k for k, r in got.items() if r.error] == ["s3"] and got["s3"].score is None and sum(r.score or 0 for r in got.values()) == 8
    assert samples.columns == ["sample_id", "question"]


def test_answers_and_similarity(spark):
    rows = spark.createDataFrame([("r1", "one two three four five", 0.0), ("r1", "one two three four five", 0.5), ("r2", "a b c d", 1.0)], "ref_image string, question string, intensity double")
    out = scoring.answer_similarity(scoring.score_with_references(rows, scoring.EchoAnswers()))
    got = {(r.ref_image, r.intensity): r.cognitive_score for r in out.collect()}
    assert got["r1", 0.0] > 0.9 and got["r2", 1.0] == 0.0 and 0 < got["r1", 0.5] < got["r1", 0.0]


def test_stream_resumes(spark, folder, tmp_path):
    rows = J.read_arrays(spark, f"{folder}/train", SMALL).select("sample_id", "question")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: resume.score_stream(spark, f"{tmp_path}/in", "sample_id string, question string", scoring.ConstantScorer(0.5), f"{tmp_path}/out", f"{tmp_path}/log")
    assert run() == 35 and run() == 0
    rows.limit(4).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 4 and spark.read.parquet(f"{tmp_path}/out").count() == 39


def test_consolidation(spark):
    samples = spark.createDataFrame([("a", {"old": 1.0}, 1.0), ("b", {"old": 0.3}, 0.3)], "sample_id string, vlm_scores map<string,double>, cognitive_score double")
    scores = spark.createDataFrame([("a", "m1", 0.2, 0), ("a", "m1", 0.4, 1), ("a", "m2", 0.1, 0), ("z", "m1", 1.0, 0)], "sample_id string, model string, score double, ord int")
    got = {r.sample_id: (r.vlm_scores, r.cognitive_score) for r in R.consolidate(samples, scores).collect()}
    assert got == {"a": ({"m1": 0.4, "m2": 0.1}, 0.25), "b": ({"old": 0.3}, 0.3)}
    assert [r.sample_id for r in R.orphan_scores(samples, scores).collect()] == ["z"]


def test_path_containment(spark):
    cases = {"/a\\b": "a/b", "../x": None, "a/../../x": None, "a/./b/..": "a/./b/.."}
    assert {k: spark.range(1).select(R.contained_path(F.lit(k))).first()[0] for k in cases} == cases


def test_truncated_pairs(spark):
    got = spark.range(1).select(R.truncated_pairs(F.array(F.lit(1), F.lit(2)), F.array(F.lit("x")))).first()[0]
    assert len(got) == 1 and tuple(got[0]) == (1, "x")


def test_entry_points(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "quality_by_category" in names
    df = entry.entry(spark)
    assert df.columns == ["kind", "srcc", "plcc", "rmse", "n"] and df.count() == 2


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    from viewgrade.plans import registry

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name in os.listdir(d):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{d}/{name}'")

    def norm(v):
        return f"{v:.9g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)

    for name in ("quality_by_category", "score_consolidation", "table_one", "means_by_level", "split_lookup", "zipped_views", "identifier_rules", "rouge_l", "tf_idf"):
        df, r = registry.QUERIES[name](spark, d), c.execute(registry.ORACLE_SQL[name])
        at = [x[0] for x in r.description]
        want = sorted([norm(row[at.index(x)]) for x in sorted(at)] for row in r.fetchall())
        assert sorted(df.columns) == sorted(at) and sorted([norm(row[x]) for x in sorted(at)] for row in df.collect()) == want, name


def test_dataset_digest(spark, folder):
    first = J.dataset_digest(spark, folder).first().digest
    assert len(first) == 16 and J.dataset_digest(spark, folder).first().digest == first
    dump(f"{folder}/train/More_VQA_train.json", [])
    assert J.dataset_digest(spark, folder).first().digest != first


def test_without_the_training_subpackage(tmp_path):
    """The engine works where the training-data folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/viewgrade", f"{tmp_path}/viewgrade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.makedirs(f"{tmp_path}/viewgrade/llm/__pycache__")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'table_one' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_sidecars_and_missing_files(spark, tmp_path):
    detail = lambda i: {"sample_id": i, "prompt": "p", "ref_answer": "a", "dist_answer": "b", "bleu": 0.5, "rouge_l": 0.25, "cider": 1.0}
    dump(f"{tmp_path}/m1/train/a.json", [detail("x"), detail("y")])
    dump(f"{tmp_path}/m2/test/a.json", [detail("z")])
    dump(f"{tmp_path}/m2/a.json", [detail("too high")])
    dump(f"{tmp_path}/m2/test/deep/a.json", [detail("too deep")])
    dump(f"{tmp_path}/m2/test/b.json", {"not": "an array"})
    got = J.sidecars(spark, str(tmp_path)).collect()
    assert sorted((r.model, r.split, r.sample_id, r.ord, r.bleu) for r in got) == [("m1", "train", "x", 0, 0.5), ("m1", "train", "y", 1, 0.5), ("m2", "test", "z", 0, 0.5)]
    manifest = spark.createDataFrame([(1, "m1/train/a.json"), (2, "m1/train/b.json"), (3, None), (4, "./m2/a.json"), (5, "train/a.json")], "id int, path string")
    assert sorted(r.id for r in J.missing_files(manifest, "path", str(tmp_path)).collect()) == [2, 5]
    notes = J.annotation_files
    dump(f"{tmp_path}/Sim3/Annotations/one.json", [{"img1": "i", "Quality": "Good (4/5)"}])
    dump(f"{tmp_path}/Sim3/Annotations/two_VQA_x.json", [{"img1": "no", "Quality": "Good (4/5)"}])
    dump(f"{tmp_path}/Sim3/other/one.json", [{"img1": "no", "Quality": "Good (4/5)"}])
    assert [r.img1 for r in notes(spark, str(tmp_path), "img1 string, Quality string").collect()] == ["i"]


class Forgets(scoring.EchoAnswers):
    def score(self, rows):
        if rows["question"].str.contains("forget").any():
            raise RuntimeError("nothing")
        return super().score(rows)


def test_several_prompts(spark):
    rows = spark.createDataFrame([("a", "r", ["one two three four five", "please forget this"], 0.0), ("b", "r", ["a long way to go", "one two three four five"], 0.5), ("c", "q", ["forget"], 0.1)], "sample_id string, ref_image string, prompts array<string>, intensity double")
    got = {r.sample_id: r for r in scoring.score_prompts(rows, Forgets()).collect()}
    assert got["a"].cognitive_score > 0.9 and [d.error is None for d in got["a"].details] == [True, False] and got["a"].details[1].question == "please forget this"
    assert got["c"].cognitive_score is None and got["b"].bleu == pytest.approx(sum(d.bleu for d in got["b"].details) / 2)


def test_latex_table(spark):
    rows = spark.createDataFrame([("Sim_3", 5, 0.25), ("Total & all", None, None)], "dataset string, refs int, share double")
    got = sinks.latex_table(rows, {"dataset": "Source", "refs": "Ref. images", "share": "Share"}, ["dataset"], "A caption of 5%", "tab:x")
    assert got.splitlines() == [r"\begin{table}[t]", r"\centering", r"\caption{A caption of 5\%}", r"\label{tab:x}", r"\begin{tabular}{lrr}", r"\toprule", r"\textbf{Source} & \textbf{Ref. images} & \textbf{Share} \\", r"\midrule", r"Sim\_3 & 5 & 0.2500 \\", r"Total \& all & --- & --- \\", r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    with pytest.raises(ValueError):
        sinks.latex_table(spark.range(5), {"id": "Id"}, ["id"], most=4)
