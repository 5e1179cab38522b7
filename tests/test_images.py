"""Image queries, measures in batches, files beside arrays of entries, settings; against brute force on small tables."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgrade.dims import DISTORTIONS, INTENSITIES
from viewgrade.functions import codecs, images
from viewgrade.operators import scoring
from viewgrade.plans import adapters as A
from viewgrade.plans import registry
from viewgrade.settings import RunSettings, score_run
from viewgrade.sources import json_arrays as J


def mosaic(key):
    lines = []
    for r in range(A.SQUARES):
        digest = hashlib.md5(f"{key}/{r}".encode()).hexdigest()
        colours = np.array([[int(digest[6 * c + k : 6 * c + k + 2], 16) for k in (0, 2, 4)] for c in range(A.SQUARES)], np.uint8)
        lines.append(np.repeat(np.repeat(colours[None], A.SQUARE, 0), A.SQUARE, 1))
    return np.concatenate(lines)


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i % 350, i % 4, float(i), "view") for i in range(400)], "event_id long, user_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"s{i}") for i in range(1, 4)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_every_view_is_distorted_as_one_by_one(spark, tables):
    got = {(r.dataset, r.frame, r.distortion, r.view, r.method): r for r in registry.QUERIES["distorted_views"](spark, tables).collect()}
    groups = {}
    for r in A.entries(spark, tables).collect():
        groups.setdefault((r.dataset, r.sequence_frame, r.distortion), set()).add(r.uav)
    assert len(got) == 2 * sum(map(len, groups.values())) and {k[2] for k in groups} == set(DISTORTIONS)
    for (dataset, frame, distortion), views in groups.items():
        key = f"{dataset}__{frame}__{distortion}"
        intensity = float(np.random.RandomState(images.seed_of(key)).choice(INTENSITIES))
        tool = images.Distorter(distortion, (42 + int(hashlib.md5(key.encode()).hexdigest(), 16)) % 2**31)
        for view in sorted(views):
            image = mosaic(f"{dataset}/{frame}/{view}")
            done = tool.apply(image, intensity)
            for method, score in (("psnr", images.psnr_of_one(image, done)), ("ssim", images.ssim_of_one(image, done))):
                r = got[dataset, frame, distortion, view, method]
                assert (r.intensity, r.pixels_md5, r.error) == (intensity, hashlib.md5(done.tobytes()).hexdigest(), None)
                assert r.score == pytest.approx(score, abs=2e-6)


def test_a_large_group_is_a_stream(spark, monkeypatch):
    image = images.test_image(16)
    rows = [("d", None, "white_noise", 0.6, 5, v, image.tobytes(), 16, 16) for v in range(300)] + [("d", "f", "nothing", 0.6, 5, 1, image.tobytes(), 16, 16), ("d", "g", "contrast", None, 5, 1, image.tobytes(), 16, 16), ("d", "h", None, 0.6, 5, 1, image.tobytes(), 16, 16)]
    views = spark.createDataFrame(rows, "dataset string, frame string, distortion string, intensity double, seed long, view long, image binary, h int, w int")
    monkeypatch.setattr(images, "HELD", 2000)  # a few images are passed on at a time
    got = images.distort_groups(views.repartition(7)).collect()
    tool = images.Distorter("white_noise", 5)
    assert [bytes(r.distorted) for r in sorted((r for r in got if r.frame is None), key=lambda r: r.view)] == [tool.apply(image, 0.6).tobytes() for _ in range(300)]
    assert {r.frame for r in got if r.error} == {"f", "g", "h"} and len(got) == len(rows)
    assert images.distort_groups(views.limit(0)).count() == 0


def test_the_catalogue_covers_every_image(spark, tables):
    got = {(r.distortion, r.intensity): r for r in registry.QUERIES["distorted_catalogue"](spark, tables).collect()}
    assert set(got) == {(n, i) for n in DISTORTIONS for i in INTENSITIES} and {r.n for r in got.values()} == {3}
    for n, i in (("white_noise", 0.2), ("jpeg_compression", 1.0)):
        want = [images.psnr(mosaic(f"supplier/{k}"), images.Distorter(n).apply(mosaic(f"supplier/{k}"), i)) for k in (1, 2, 3)]
        assert got[n, i].psnr == pytest.approx(sum(want) / 3, abs=2e-6)
    rows = spark.createDataFrame([(1, None, 2, 2), (2, b"abc", 2, 2)], "name long, image binary, h int, w int")
    assert images.catalogue_sweep(rows).count() == 0


def test_spectra(spark, tables):
    got = {(r.name, r.radius): r.magnitude for r in registry.QUERIES["log_polar_features"](spark, tables).collect()}
    for k in (1, 2, 3):
        want = images.log_polar_feature(mosaic(f"supplier/{k}")).sum(1)
        assert [got[k, r] for r in range(32)] == pytest.approx(list(want), abs=2e-6)
    bad = images.log_polar_features(spark.createDataFrame([(None, 2, 2), (b"abc", 2, 2)], "image binary, h int, w int")).collect()
    assert all(r.feature is None and r.error for r in bad)


def test_methods_in_batches_and_rows(spark):
    sizes = []

    def many(xs, refs):
        sizes.append(len(xs))
        if any(x[0, 0, 0] == 9 for x in xs):
            raise RuntimeError("nine")
        return [float(x[0, 0, 0]) for x in xs]

    image = lambda v: np.full((8, 8, 3), v, np.uint8).tobytes()
    rows = [(k, image(k), image(k + 1) if k % 2 else None, 8, 8, 8, 8) for k in range(12)] + [(12, None, None, 8, 8, 8, 8), (13, b"abc", None, 8, 8, 8, 8)]
    pairs = spark.createDataFrame(rows, "id int, image binary, ref binary, h int, w int, ref_h int, ref_w int").coalesce(1)
    found = images.score_methods(pairs, {"many": images.Method(many, True), "psnr": images.METHODS["psnr"], "one": lambda x, r: images.psnr_of_one(r, x)}, batch=5).collect()
    got = {(r.id, r.method): r for r in found}
    assert len(found) == 14 * 3
    assert [got[k, "many"].score for k in range(12)] == [float(k) if k != 9 else None for k in range(12)] and "nine" in got[9, "many"].error
    assert all(got[k, "psnr"].score == got[k, "one"].score and got[k, "psnr"].error is None for k in range(12))
    assert all(got[k, m].score is None and got[k, m].error for k in (12, 13) for m in ("many", "psnr", "one"))
    with pytest.raises(ValueError):
        images.psnr_of_many([np.zeros((2, 2, 3), np.uint8)], [])


def test_digest_of_bytes_on_end(spark, tmp_path):
    assert J.stream_digest(spark, str(tmp_path)) == ""
    parts = {"b_test.json": b"[3]", "sub/c_train.json": b"[2]", "a_train.json": b"[1]", "z.json": b"[4]", "no.txt": b"x"}
    os.makedirs(f"{tmp_path}/sub")
    for name, body in parts.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(body)
    assert J.stream_digest(spark, str(tmp_path)) == hashlib.sha256(b"[1][2][3][4]").hexdigest()[:16]
    with pytest.raises(ValueError, match="more than 5"):
        J.stream_digest(spark, str(tmp_path), most=5)


FOLDERS = {"input_dir": "i", "output_dir": "o", "progress_dir": "p"}


def test_settings(spark, tmp_path):
    s = RunSettings.of({**FOLDERS, "batch_size": "8", "scorer_options": '{"value": 1}'})
    assert (s.batch_size, s.chunk_size, s.scorer_options, s.resources()["spark.task.resource.gpu.amount"]) == (8, 256, {"value": 1}, "1")
    for bad in ({"batch_size": 0}, {"batch_size": "x"}, {"seed": True}, {"seed": 1.5}, {"colour": 1}, {"model_name": " "}, {"raw_data_dir": 5}, {"scorer_options": "[1]"}):
        with pytest.raises(ValueError):
            RunSettings.of({**FOLDERS, **bad})
    with pytest.raises(ValueError, match="output_dir, progress_dir"):
        RunSettings.of({"input_dir": "i"})
    with open(f"{tmp_path}/run.json", "w") as f:
        json.dump({**FOLDERS, "max_entries": 5}, f)
    assert RunSettings.from_file(spark, f"{tmp_path}/run.json", seed=7) == RunSettings("i", "o", "p", max_entries=5, seed=7)
    try:
        for k, v in {"inputDir": "i", "output_dir": "o", "progressDir": "p", "numGpus": "0"}.items():
            spark.conf.set(f"spark.viewgrade.{k}", v)
        assert RunSettings.from_session(spark) == RunSettings("i", "o", "p", num_gpus=0) and not RunSettings.from_session(spark).resources()
    finally:
        for k in ("inputDir", "output_dir", "progressDir", "numGpus"):
            spark.conf.unset(f"spark.viewgrade.{k}")


class Lengths:
    def prepare(self):
        pass

    def score(self, rows):
        if len(rows) > 3:
            raise AssertionError("a batch of four")
        return [float(len(q)) for q in rows["question"]]


def test_a_run_by_its_settings(spark, tmp_path):
    for name, n in (("train/A_VQA_train.json", 6), ("B_VQA_test.json", 4), ("other.json", 2)):
        os.makedirs(os.path.dirname(f"{tmp_path}/in/{name}"), exist_ok=True)
        with open(f"{tmp_path}/in/{name}", "w") as f:
            json.dump([{"sample_id": f"{name[0]}{k}", "question": "q" * k} for k in range(n)], f)
    settings = RunSettings.of({"input_dir": f"{tmp_path}/in", "output_dir": f"{tmp_path}/out", "progress_dir": f"{tmp_path}/log", "batch_size": 3, "max_entries": 8})
    first = score_run(spark, settings, Lengths()).orderBy("source_file", "ord").collect()
    assert [(r.source_file, r.ord, r.score) for r in first] == [("B_VQA_test.json", k, float(k)) for k in range(4)] + [("train/A_VQA_train.json", k, float(k)) for k in range(4)]
    with open(f"{tmp_path}/out/train/A_VQA_train.json") as f:
        assert [r["score"] for r in json.load(f)] == [0.0, 1.0, 2.0, 3.0]
    again = score_run(spark, RunSettings.of({"input_dir": f"{tmp_path}/in", "output_dir": f"{tmp_path}/out", "progress_dir": f"{tmp_path}/log"}), scoring.ConstantScorer(0.5)).collect()
    assert {r.sample_id: r.score for r in again} == {f"{c}{k}": float(k) if k < 4 else 0.5 for c, n in (("t", 6), ("B", 4)) for k in range(n)}


CODECS = {"wavelet": (codecs.wavelet_encode, codecs.wavelet_decode), "predicted": (codecs.predicted_encode, codecs.predicted_decode)}


def textured(h, w):
    y, x = np.mgrid[:h, :w]
    waves = 128 + 60 * np.sin(x / 5) * np.cos(y / 9)
    grain = np.random.RandomState(4).normal(0, 8, (h, w, 3))
    return np.clip(np.stack([waves, 255 - waves, (x + y) % 256], -1) + grain, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("name", CODECS)
def test_rate_and_distortion_grow_with_quality(name):
    encode, decode = CODECS[name]
    image = textured(61, 83)
    qualities = (1, 15, 30, 45, 60, 75, 90, 100)
    coded = [encode(image, q) for q in qualities]
    fidelity = [images.psnr(image, decode(c)) for c in coded]
    assert all(decode(c).shape == image.shape for c in coded)
    assert all(len(a) <= len(b) for a, b in zip(coded, coded[1:], strict=False)) and len(coded[0]) * 4 < len(coded[-1]) <= image.size * 1.2
    assert all(a <= b + 0.05 for a, b in zip(fidelity, fidelity[1:], strict=False)) and fidelity[-1] > fidelity[0] + 8


def test_the_wavelet_codec_loses_nothing_at_the_top():
    for shape in ((1, 1), (7, 40), (64, 64)):
        image = np.random.RandomState(1).randint(0, 256, (*shape, 3)).astype(np.uint8)
        assert np.array_equal(codecs.wavelet_decode(codecs.wavelet_encode(image, 100)), image)
        assert codecs.predicted_decode(codecs.predicted_encode(image, 50)).shape == image.shape


def test_forecasts_pay():
    stripes = np.repeat(np.random.RandomState(2).randint(0, 256, (1, 96, 1)), 96, 0).repeat(3, 2).astype(np.uint8)
    grain = np.random.RandomState(2).randint(0, 256, (96, 96, 1)).repeat(3, 2).astype(np.uint8)
    assert 8 * len(codecs.predicted_encode(stripes, 60)) < len(codecs.predicted_encode(grain, 60))
    taken = []
    codecs.by_blocks((32, 32), 16, 1.0, lambda i, j, guess: (taken.append(len(guess)) or codecs.DOWN, np.zeros((4, 4, 4, 4))))
    assert taken == [4] * 4


def test_images_of_a_shape_are_distorted_together_to_the_same_bytes(spark, monkeypatch):
    rng = np.random.RandomState(3)
    rows = []
    for k, name in enumerate(DISTORTIONS):
        for v in range(3):
            side = 16 + 16 * ((k + v) % 2 if k % 5 == 0 else 0)  # in some groups the shape changes, and the intensity
            rows.append(("d", f"f{k}", name, INTENSITIES[(k + (v if k % 7 == 0 else 0)) % 5], 5 + k, v, rng.randint(0, 256, (side, side, 3)).astype(np.uint8).tobytes(), side, side))
            rows.append(("d", f"g{k}", name, INTENSITIES[k % 5], 9, v, rows[-1][6], side, side))
    together = []
    for n in DISTORTIONS:
        monkeypatch.setitem(images.KERNELS, n, lambda x, i, rngs, f=images.KERNELS[n]: together.append(len(x)) or f(x, i, rngs))
    df = spark.createDataFrame(rows, "dataset string, frame string, distortion string, intensity double, seed long, view long, image binary, h int, w int")
    work = images.Waiting(len(rows), np.random.RandomState())
    streams = {}
    for k, r in enumerate(rows):
        work.add(k, r[2], r[3], images.pixels(r[6], r[7], r[8]), streams.setdefault(r[:3], images.Stream(r[2], r[4])))
    work.distort()
    assert max(together) > 3
    tools, want = {}, []
    for r in rows:
        want.append(tools.setdefault(r[:3], images.Distorter(r[2], r[4])).apply(images.pixels(r[6], r[7], r[8]), r[3]).tobytes())
    assert work.done == want and not any(work.errors)
    found = {(r.frame, r.distortion, r.view): bytes(r.distorted) for r in images.distort_groups(df.repartition(3)).collect()}
    assert [found[r[1], r[2], r[5]] for r in rows] == want
    pairs = [(images.pixels(*r[6:]), images.pixels(w, *r[7:])) for r, w in zip(rows, want, strict=True)]
    assert images.ssim_of_many([b for _, b in pairs], [a for a, _ in pairs]) == [images.ssim_of_one(a, b) for a, b in pairs]


@pytest.mark.parametrize("quality", [1, 40, 77, 100])
def test_codecs_of_many_images_give_what_is_decoded(quality):
    many = np.random.RandomState(4).randint(0, 256, (3, 21, 35, 3)).astype(np.uint8)
    many[1] = images.test_image(35)[:21]
    decoded = [codecs.wavelet_decode(codecs.wavelet_encode(x, quality)) for x in many]
    assert np.array_equal(codecs.wavelet_lossy(many, quality), decoded)
    each = [quality, 50, 99]
    decoded = [codecs.predicted_decode(codecs.predicted_encode(x, q)) for x, q in zip(many, each, strict=True)]
    assert np.array_equal(codecs.predicted_lossy(many, each), decoded)


def test_the_catalogue_makes_once_what_its_cells_have_in_common(monkeypatch):
    many = np.random.RandomState(5).randint(0, 256, (3, 21, 35, 3)).astype(np.uint8)
    many[1] = images.test_image(35)[:21]
    want = [[(images.psnr(x, y), images.ssim(x, y)) for x, y in ((x, images.Distorter(n).apply(x, i)) for x in many)] for n, i in images.CELLS]
    calls = []
    for f in {f: n for n, f in images.KERNELS.items()}:
        counted = lambda *a, f=f: calls.append(len(a)) or f(*a)
        for n in [n for n, g in images.KERNELS.items() if g is f]:
            monkeypatch.setitem(images.KERNELS, n, counted)
    kept = {n: [] for n in images.SHARED}
    for n, f in images.SHARED.items():
        monkeypatch.setitem(images.SHARED, n, lambda x, n=n, f=f: kept[n].append(len(x)) or f(x))
    got = images.catalogue_figures(many, np.random.RandomState())
    assert np.abs(np.array(got).transpose(0, 2, 1) - np.array(want)).max() < 1e-9
    assert len(calls) == 5 * len(set(images.KERNELS.values())) == 5 * 33 and kept == {"cnn_denoise": [3], "atmospheric_scattering_haze": [3]}
    large = np.random.RandomState(6).randint(0, 256, (1, 75, 130, 3)).astype(np.uint8)  # blurred in several strips a side
    psnr, ssim = images.Originals(large).against(255 - large)
    assert (psnr[0], ssim[0]) == pytest.approx((images.psnr(large, 255 - large), images.ssim(large[0], 255 - large[0])), abs=1e-9)


def test_groups_are_scored_as_they_are_distorted(spark, tables, monkeypatch):
    views = A.views(spark, tables).withColumn("intensity", F.lit(0.6))
    assert {len(r.image) for r in views.select("image").collect()} == {3 * A.SQUARES**2}  # what is shuffled and sorted
    plan = images.score_groups(views, scale=A.SQUARE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.index("MapInPandas") < plan.index("Sort") < plan.index("Repartition")  # no image goes from task to task
    one, rng = "dataset string, frame string, distortion string, intensity double, seed long, view long, image binary, h int, w int", np.random.RandomState(8)
    small = [rng.randint(0, 256, (3, 4, 3)).astype(np.uint8) for _ in range(120)]
    rows = [("d", f"f{k // 7}" if k % 11 else None, list(DISTORTIONS)[k // 7 % 36], 0.4, k // 7, k, x.tobytes(), 3, 4) for k, x in enumerate(small)]
    rows += [("d", "g", "contrast", 0.4, 5, 1, None, 3, 4), ("d", "g", "contrast", 0.4, 5, 2, b"abc", 3, 4), ("d", "h", "contrast", None, 5, 1, rows[0][6], 3, 4), ("d", "i", "nothing", 0.4, 5, 1, rows[0][6], 3, 4), ("d", "j", None, 0.4, 5, 1, rows[0][6], 3, 4), ("d", "k", "contrast", 0.4, None, 1, rows[0][6], 3, 4)]
    large = [(*r[:6], images.pixels(*r[6:]).repeat(8, 0).repeat(8, 1).tobytes(), 24, 32) if r[6] and len(r[6]) > 3 else r for r in rows]
    monkeypatch.setattr(images, "HELD", 9000)  # a few images are passed on at a time
    done = images.distort_groups(spark.createDataFrame(large, one)).withColumns({"pixels_md5": F.md5("distorted"), "ref": F.col("image"), "ref_h": F.col("h"), "ref_w": F.col("w")}).drop("image", "error").withColumnRenamed("distorted", "image")
    key = ["dataset", "frame", "distortion", "view", "pixels_md5", "method", "score", "error"]
    want = {str(tuple(r)) for r in images.score_methods(done).select(key).collect()}
    got = [str(tuple(r)) for r in images.score_groups(spark.createDataFrame(rows, one).repartition(5), scale=8).select(key).collect()]
    assert set(got) == want and len(got) == len(want) == 2 * len(rows) and sum("Error" in r for r in got) == 12
    assert {str(tuple(r)) for r in images.score_groups(spark.createDataFrame(large, one)).select(key).collect()} == want
    parts = list(images.enlarged(iter([spark.createDataFrame(rows, one).toPandas()]), 8, 9000))
    assert max(sum(len(x) for x in p["image"] if x is not None) for p in parts) <= 9000 + 2 * 24 * 32 * 3 and sum(map(len, parts)) == len(rows)


def test_a_generator_is_copied_for_further_images_only(monkeypatch):
    copies = []

    class Counted(np.random.RandomState):
        def get_state(self, *a, **k):
            copies.append(1)
            return super().get_state(*a, **k)

    monkeypatch.setattr(np.random, "RandomState", Counted)
    import pandas as pd

    image = images.test_image(16)
    rows = [("d", f"f{k}", "white_noise", 0.6, k, v, image.tobytes(), 16, 16) for k in range(40) for v in range(3)]
    pdf = pd.DataFrame(rows, columns=["dataset", "frame", "distortion", "intensity", "seed", "view", "image", "h", "w"])
    got = [bytes(x) for part in images.distorted(iter([pdf[:50], pdf[50:]]), 1 << 20) for x in part["distorted"]]
    assert len(copies) == 2  # at the end of each batch, where the last group might go on
    assert got == [tool.apply(image, 0.6).tobytes() for k in range(40) for tool in [images.Distorter("white_noise", k)] for _ in range(3)]


def test_windows_are_added_up_exactly():
    x = np.random.RandomState(9).randint(0, 256, (2, 9, 23, 3)).astype(np.float64)
    for size in (1, 2, 3, 7, 9, 10):
        got, want = images.windows(images.windows(x, size, 1), size, 2), [[x[:, i : i + size, j : j + size].sum((1, 2)) for j in range(24 - size)] for i in range(10 - size)]
        assert got.shape == (2, max(0, 10 - size), 24 - size, 3) and (not want or np.array_equal(got, np.array(want).transpose(2, 0, 1, 3)))
    pairs = [np.random.RandomState(k).randint(0, 256, (31, 19, 3)).astype(np.uint8) for k in range(4)]
    for size in (7, 17):  # sums in single and in double precision
        a, b = pairs[0].astype(float), pairs[1].astype(float)
        n, mean = size**2 / (size**2 - 1), lambda v: np.array([[v[i : i + size, j : j + size].sum((0, 1)) for j in range(20 - size)] for i in range(32 - size)]) / size**2
        ma, mb = mean(a), mean(b)
        va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        assert images.ssim_of_one(pairs[0], pairs[1], size) == pytest.approx((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean(), abs=1e-12)


def test_equal_bytes_are_measured_once(monkeypatch):
    measured, against = [], images.Originals.against
    monkeypatch.setattr(images.Originals, "against", lambda self, x: measured.append(x.tobytes()) or against(self, x))
    figures = dict(zip(images.CELLS, images.catalogue_figures(images.test_image(32)[None], np.random.RandomState()), strict=True))
    assert len(figures) == 180 and all(a != b for a, b in zip(measured, measured[1:], strict=False))
    assert all(figures["grayscale", i] is figures["grayscale", 0.2] for i in INTENSITIES) and figures["color_quantize", 0.4] is figures["color_quantize", 0.6] is not figures["color_quantize", 0.8]
