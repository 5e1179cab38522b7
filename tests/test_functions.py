"""Scalar rules, text similarity, statistics and image kernels against plain Python."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewgrade.dims import DISTORTIONS, INTENSITIES
from viewgrade.functions import images, stats, strings, text
from viewgrade.operators import relational as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_distortion_keys(spark):
    cases = {"gaussian_blur_L04": ("gaussian_blur", 0.4), "ref__propeller_shadow_L4.png": ("propeller_shadow", 0.4), "a/b__white_noise_L10.jpeg": ("white_noise", 1.0), "no_level": (None, None), "color_noise_L0_5": (None, None), "x__y_L0.png": ("y", 0.0)}
    for key, want in cases.items():
        assert one(spark, *strings.distortion_key(F.lit(key))) == want, key


def test_identifiers(spark):
    lit = F.lit
    assert one(spark, strings.view_id(lit("Sim3_what2col_UAV2_1"), lit("")), strings.view_id(lit("x_UAV13"), lit("")), strings.view_id(lit("x"), lit("1.1 Scene (UAV4)")), strings.view_id(lit("x"), lit(None).cast("string"))) == ("UAV2", "UAV13", "UAV4", "UAV1")
    assert one(spark, *(strings.subtask_name(lit(x)) for x in ("1.1 Scene", "4.2 What to Collaborate", "Object Matching", "object_counting", "9.9 nothing", ""))) == ("scene_description", "what_to_collaborate", "object_matching", "scene_description", "scene_description", "scene_description")
    assert one(spark, *(strings.subtask_id(lit(x)) for x in (" 4.4 Why", "1.2", "7.7"))) == (13, 1, 0)
    assert one(spark, strings.sample_id(lit("Sim3"), lit("a/b\\c"), lit("gaussian_blur"), lit(4)), strings.sample_id(lit("Sim3"), lit("f"), lit("g"), lit(100), lit("train"), lit(None).cast("string"))) == ("Sim3__a_b_c__gaussian_blur_L04", "Sim3__train__f____g_L100")
    assert one(spark, strings.reference_id(lit("/Sim_3\\x/UAV1/f_001.jpg")), strings.dataset_name(lit("Real2_VQA_test.json")), strings.dataset_name(lit("a_b.json")), strings.path_stem(lit("a.b/.hidden")), strings.path_stem(lit("x/y.tar.gz"))) == ("Sim_3_x_UAV1_f_001", "Real2", "a", ".hidden", "y.tar")
    assert one(spark, *(strings.quality_score(lit(x)) for x in ("Good (4/5)", "Very Poor (1/5)", "none")), *(strings.usability_score(lit(x)) for x in (" 1 (Available)", "2", "3", "x"))) == (0.8, 0.2, 0.5, 1.0, 0.5, 0.25, 0.0)
    parts = one(spark, strings.sample_id_parts(lit("Sim3__train__s_1__Q1__gaussian_blur_L04")))[0]
    assert tuple(parts) == ("Sim3", "train", "s_1", "Q1", "gaussian_blur", 0.4)
    assert one(spark, *(strings.duration(lit(x)) for x in (-3, 59, 60, 3661))) == ("0s", "59s", "1m 00s", "1h 01m 01s")
    assert one(spark, strings.char_ids(lit("aé ")))[0] == [3, 1, 2]
    names = strings.model_name
    assert one(spark, *(names(lit(x), {"old": "new"}, {"new": "org/new-7b"}) for x in ("old", "org/new-7b", "org/else", "what"))) == ("new", "new", "org/else", None)


def test_seed_equals_the_digest(spark):
    import hashlib

    key = "Sim3__scene_1__white_noise"
    want = (42 + int(hashlib.md5(key.encode()).hexdigest(), 16)) % 2**31
    assert one(spark, strings.distortion_seed(F.lit("Sim3"), F.lit("scene_1"), F.lit("white_noise")))[0] == want


def bleu(ref, hyp, most=4):
    if not hyp:
        return 0.0
    logs = []
    for n in range(1, most + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (ref, hyp))
        total, hit = sum(b.values()), sum(min(c, a[g]) for g, c in b.items())
        p = 0.0 if not a or not total else hit / total if hit else 1 / (total + 1)
        logs.append(math.log(max(p, 1e-10)))
    return min(1.0, (1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / max(len(hyp), 1))) * math.exp(sum(logs) / most))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def cider(ref, hyp):
    bags = [Counter(tuple(x[i : i + n]) for n in range(1, 5) for i in range(len(x) - n + 1)) for x in (ref, hyp)]
    if not ref or not hyp:
        return 0.0
    idf = {g: math.log(3 / (sum(g in b for b in bags) + 1)) + 1 for b in bags for g in b}
    v = [{g: c / sum(b.values()) * idf[g] for g, c in b.items()} for b in bags]
    dot, norm = sum(x * v[1].get(g, 0) for g, x in v[0].items()), math.prod(math.sqrt(sum(x * x for x in y.values())) for y in v)
    return 10 * dot / norm if norm else 0.0


PAIRS = [("the cat sat on the mat by the door", "the cat sat on the mat by the door"), ("a b", "a b"), ("alpha beta gamma", "one two three four"), ("x y z", ""), ("", "x"), ("a a a b", "a a b b b a"), ("the the the the", "the the"), ("é　ü\x1cx", "É ü X"), ("one two three four five", "one two three five four one")]


def test_text_similarity(spark):
    df = spark.createDataFrame(PAIRS, "r string, h string").select("r", "h", text.tokens(F.col("r")).alias("a"), text.tokens(F.col("h")).alias("b"))
    df = df.withColumn("lcs", text.lcs("a", "b"))
    for r in df.select("*", text.bleu(F.col("a"), F.col("b")).alias("bleu"), text.rouge_l(F.col("lcs"), F.col("a"), F.col("b")).alias("rouge"), text.cider(F.col("a"), F.col("b")).alias("cider")).collect():
        a, b = r.r.lower().split(), r.h.lower().split()
        assert (r.a, r.b) == (a, b) and r.lcs == lcs(a, b)
        assert r.bleu == pytest.approx(bleu(a, b), abs=1e-12) and r.cider == pytest.approx(cider(a, b), abs=1e-9)
        assert r.rouge == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if lcs(a, b) else 0.0)


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs_helper(a, b):
    assert text._lcs(a, b) == lcs(a, b)


def test_long_equal_texts_have_a_common_length_at_once():
    began = time.perf_counter()
    assert text._lcs(["a"] * 20_000, ["a"] * 20_000) == 20_000 and text._lcs(["a", "b"] * 10_000, ["b"] * 20_000) == 10_000
    assert time.perf_counter() - began < 2


def test_blocks_of_a_corpus_give_the_same(spark):
    """A word in every document; one block of grams, or one for about each text."""
    rng = np.random.default_rng(2)
    texts = [["every"] + rng.choice(list("abcdef"), 6).tolist() for _ in range(25)] + [[], ["every"], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    hyps = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate([*texts[:6], ["zz", "every"], ["zz"], [], None])], "hyp_id string, tokens array<string>")
    one, many = ({r.hyp_id: r.cider for r in text.cider_of_corpus(hyps, docs, rows=rows).collect()} for rows in (1 << 20, 20))
    assert len(one) == 10 and one == pytest.approx(many, rel=1e-12) and one["h0"] > one["h6"] > one["h7"] == one["h8"] == 0.0


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_kendall(pairs):
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    got = stats.kendall(x, y)
    s = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            tx += x[i] != x[j]
            ty += y[i] != y[j]
    if len(x) < 3:
        assert got == 0.0
    elif not tx or not ty:
        assert math.isnan(got)
    else:
        assert got == pytest.approx(s / math.sqrt(tx * ty))


def test_one_group_of_ties(spark):
    """Ranks, tau and the running sums of one group, of which a third has one value, against brute force."""
    rng = np.random.default_rng(8)
    n = 3000
    x = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(size=n) * 50, 1))
    y = np.where(rng.random(n) < 0.34, 1e6, np.round(1e6 + x + rng.normal(size=n) * 40))
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "distortion string, id long, pred double, target double")
    mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = {r.id: r.rank for r in stats.with_average_rank(df, ["distortion"], "pred", "rank").collect()}
    assert [got[i] for i in range(n)] == mean_rank(x).tolist()
    r = stats.all_metrics(df, ["distortion"]).first()
    assert r.srcc == pytest.approx(np.corrcoef(mean_rank(x), mean_rank(y))[0, 1], abs=1e-12) and r.plcc == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9) and r.n == n
    assert r.kendall_tau == pytest.approx(stats.kendall(x, y), abs=1e-12) and r.rmse == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
    few = slice(0, 600)
    sx, sy = np.sign(x[few, None] - x[few]), np.sign(y[few, None] - y[few])
    assert stats.kendall(x[few], y[few]) == pytest.approx((sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum()))
    p = x / 100
    order = np.lexsort((np.arange(n), -y))
    tails = np.log(np.cumsum(np.exp(p[order])[::-1])[::-1])
    loss = R.list_mle(df.withColumn("pred", F.col("pred") / 100)).first().loss
    assert loss == pytest.approx((tails - p[order]).mean(), rel=1e-9)


def test_a_group_is_dealt_to_several_tasks(spark):
    """One group of one list, most rows with one value, over many small ranges: no range holds it, and all figures stand."""
    rng = np.random.default_rng(3)
    n = 4000
    x, y = np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 2500, n) / 10), np.where(rng.random(n) < 0.4, 9.0, rng.integers(0, 2500, n))
    df = spark.createDataFrame([("g" if i % 50 else None, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, pred double, target double")
    keys = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        parts = stats.dealt(df, "g", "pred", "target").where("g = 'g'").groupBy("_part").count().collect()
        assert len(parts) > 8 and max(r["count"] for r in parts) < n / 2
        got = {r.g: r for r in stats.all_metrics(df, ["g"], "pred", "target").collect()}
        alone = stats.all_metrics(df.drop("g"), [], "pred", "target").first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    at = np.arange(n) % 50 != 0
    for own, r in ((at, got["g"]), (~at, got[None]), (at | True, alone)):
        assert r.n == own.sum() and r.kendall_tau == pytest.approx(stats.kendall(x[own], y[own]), abs=1e-12)
        mean_rank = [np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, "right") for v in (x[own], y[own])]
        assert r.srcc == pytest.approx(np.corrcoef(*mean_rank)[0, 1], abs=1e-12) and r.plcc == pytest.approx(np.corrcoef(x[own], y[own])[0, 1], abs=1e-12)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1023), st.integers(1, 5)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_smaller_digits_before(rows):
    rows.sort(key=lambda r: r[0])
    node, digit, m = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    want = [sum(m[i] for i in range(j) if node[i] == node[j] and digit[i] < digit[j]) for j in range(len(rows))]
    assert stats._smaller_before(node, digit, m.astype(float)).tolist() == want


def test_dominated_pairs_by_group():
    rng = np.random.default_rng(1)
    g, x, y, m = rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.integers(1, 4, 300)
    want = [sum(m[i] * m[j] for i in range(300) if g[i] == g[j] and x[i] < x[j] and y[i] < y[j]) for j in range(300)]
    assert stats.dominated(x, y, m, g).tolist() == want and len(stats.dominated(x[:0], y[:0], m[:0])) == 0


def test_cider_of_several_references_and_a_corpus(spark):
    refs = ["a b c d", "a b x", ""]
    hyp = "a b c e"

    def brute(docs, many):
        bags = [Counter(tuple(w[i : i + n]) for w in [d.split()] for n in range(1, 5) for i in range(len(w) - n + 1)) for d in docs]
        df = Counter(g for b in bags for g in b)
        v = [{g: c / sum(b.values()) * (math.log((len(docs) + 1) / (df[g] + 1)) + 1) for g, c in b.items()} for b in bags]
        norm = [math.sqrt(sum(z * z for z in b.values())) for b in v]
        cos = [sum(z * v[-1].get(g, 0) for g, z in b.items()) / (n * norm[-1]) if n and norm[-1] else 0.0 for b, n in zip(v[:-1], norm, strict=False)]
        return 10 * sum(cos[:many]) / many

    one = spark.createDataFrame([(refs, hyp)], "refs array<string>, hyp string")
    got = one.select(text.cider_of(F.transform("refs", text.tokens), text.tokens(F.col("hyp")))).first()[0]
    assert got == pytest.approx(brute([*refs, hyp], 3))
    corpus = spark.createDataFrame(list(enumerate(["a b c d", "a b x", "q r", "a a a b", ""])), "doc_id int, t string").select("doc_id", text.tokens(F.col("t")).alias("tokens"))
    hyps = spark.createDataFrame([(0, hyp), (1, "q r s"), (2, ""), (3, "nothing like it")], "hyp_id int, t string").select("hyp_id", text.tokens(F.col("t")).alias("tokens"))
    found = {r.hyp_id: r.cider for r in text.cider_of_corpus(hyps, corpus).collect()}
    for i, h in ((0, hyp), (1, "q r s"), (2, ""), (3, "nothing like it")):
        assert found[i] == pytest.approx(brute(["a b c d", "a b x", "q r", "a a a b", "", h], 5), abs=1e-12)
    prompts = spark.createDataFrame([(1, "a b c d", hyp), (1, "a b", "a b"), (2, None, "x")], "k int, ref_text string, dist_text string")
    plain = {r.k: r for r in text.cognitive_scores(prompts, "k").collect()}
    assert plain[1].bleu == round((bleu("a b c d".split(), hyp.split()) + bleu(["a", "b"], ["a", "b"])) / 2, 6) and plain[2].cognitive_score == 0.0 and plain[1].n_prompts == 2
    assert {r.k: r.cider for r in text.cognitive_scores(prompts, "k", corpus=corpus).collect()}[1] == pytest.approx((found[0] + brute(["a b c d", "a b x", "q r", "a a a b", "", "a b"], 5)) / 2, abs=1e-6)


def test_cosine_over_the_union_of_keys(spark):
    m = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) if d else F.create_map().cast("map<string,double>")
    got = spark.range(1).select(text.map_cosine(m({"a": 1.0, "b": 2.0}), m({"b": 2.0, "c": 4.0})), text.map_cosine(m({"a": 1.0}), m({}))).first()
    assert got[0] == pytest.approx(4 / math.sqrt(5 * 20)) and got[1] == 0.0


def test_guarded_statistics(spark):
    rows = [("few", 1.0, 2.0), ("few", 2.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 5.0), ("tied", 1.0, 3.0), ("tied", 1.0, 2.0), ("tied", 2.0, 2.0), ("tied", 5.0, 9.0)]
    got = {r.g: r for r in stats.quality_metrics(spark.createDataFrame(rows, "g string, pred double, target double"), ["g"]).collect()}
    assert got["few"].srcc == 0.0 and got["few"].rmse == 1.0 and math.isnan(got["flat"].plcc)
    assert got["tied"].srcc == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [3, 1.5, 1.5, 4])[0, 1])


@pytest.mark.parametrize("name", DISTORTIONS)
def test_distortions(name):
    image = images.test_image(48)
    for i in (0.0, *INTENSITIES, 3.0):
        out = images.Distorter(name, 7).apply(image, i)
        assert out.shape == image.shape and out.dtype == np.uint8
        assert np.array_equal(out, images.Distorter(name, 7).apply(image, i))


def test_exact_kernels():
    image = images.test_image(64)
    assert images.psnr(image, image) == pytest.approx(80.0) and images.ssim(image, image) == pytest.approx(1.0)
    assert np.array_equal(images.Distorter("color_quantize").apply(image, 1.0), image & 0b11111000)
    lost = images.Distorter("block_lost", 3).apply(image, 1.0)
    changed = (lost != image).any(-1).reshape(4, 16, 4, 16).any((1, 3))
    assert 0 < changed.sum() < 16
    swapped = images.Distorter("block_exchange", 3).apply(image, 0.5)
    assert np.array_equal(np.sort(swapped.ravel()), np.sort(image.ravel()))
    assert images.ssim(image, images.Distorter("gaussian_blur").apply(image, 1.0)) < images.ssim(image, images.Distorter("gaussian_blur").apply(image, 0.2))
    assert images.log_polar_feature(image).shape == (32, 16)
    with pytest.raises(ValueError):
        images.Distorter("nothing")


def test_distorted_groups_share_a_generator(spark):
    image = images.test_image(32)
    rows = [("d", "f", "white_noise", 0.6, 5, v, image.tobytes(), 32, 32) for v in ("UAV2", "UAV1")] + [("d", "g", "white_noise", 0.6, 5, "UAV1", b"bad", 32, 32), ("d", "h", "white_noise", 0.6, 5, "UAV1", None, 32, 32), ("d", "i", "white_noise", 0.6, 5, "UAV1", image.tobytes(), None, 32)]
    done = images.distort_groups(spark.createDataFrame(rows, "dataset string, frame string, distortion string, intensity double, seed long, view string, image binary, h int, w int")).collect()
    got = {(r.frame, r.view): r for r in done}
    tool = images.Distorter("white_noise", 5)
    assert [bytes(got["f", v].distorted) for v in ("UAV1", "UAV2")] == [tool.apply(image, 0.6).tobytes() for _ in range(2)] and len(done) == 5
    assert all(got[f, "UAV1"].distorted is None and got[f, "UAV1"].error for f in "ghi")


def test_picked_intensities(spark):
    keys = ["a__b__c", "Sim3__s__white_noise"]
    want = [float(np.random.RandomState(images.seed_of(k)).choice(INTENSITIES)) for k in keys]
    assert [r.i for r in spark.createDataFrame([(k,) for k in keys], "k string").select(images.pick_intensity("k").alias("i")).collect()] == want


def test_list_mle_adds_up_from_the_end(spark):
    rows = [(k, "d", (k * 37 % 101) / 100, None if k % 50 == 0 else k % 7 / 7) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, distortion string, pred double, target double")
    loss = R.list_mle(df)
    plan = loss._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan  # the latter is added up anew for each row
    order = sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    want = sum(math.log(sum(math.exp(x[2]) for x in order[i:])) - r[2] for i, r in enumerate(order)) / len(order)
    assert loss.first().loss == pytest.approx(want, abs=1e-9)


def test_a_batch_of_texts_is_taken_some_rows_at_a_time():
    import pyarrow as pa

    class Watched:
        def __init__(self, a):
            self.a, self.most = a, 0

        def __len__(self):
            return len(self.a)

        def slice(self, at, n):
            self.most = max(self.most, n)
            return self.a.slice(at, n)

    rows = [None if k % 9 == 0 else ["a", "b", str(k % 3), "c"][: k % 5] for k in range(1000)]
    x, y = Watched(pa.array(rows, pa.list_(pa.string()))), Watched(pa.array(rows[::-1], pa.list_(pa.string())))
    assert len(next(text.lcs.func(iter([(x, y)])))) == 1000
    hits = next(text.gram_hits.func(iter([(x, y)]))).to_pylist()
    assert len(hits) == 1000 and {len(h) for h in hits} == {4} and x.most == y.most == text.HELD
    assert next(text.gram_hits.func(iter([(x.a.slice(0, 0), y.a.slice(0, 0))]))).to_pylist() == []


def test_choices_of_many_seeds_are_those_of_a_generator_each(monkeypatch):
    seeds = np.append(np.random.RandomState(1).randint(0, 2**31, 3000), [0, 1, 2**31 - 1])
    want = [float(np.random.RandomState(s).choice(INTENSITIES)) for s in seeds.tolist()]
    assert images.choices(seeds).tolist() == want and len(images.choices(seeds[:0])) == 0
    monkeypatch.setattr(images, "DRAWS", 1)  # most seeds need more numbers
    assert images.choices(seeds).tolist() == want
