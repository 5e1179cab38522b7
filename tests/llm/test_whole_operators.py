"""Bounds and counts of the training-data operators against brute force on small tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgrade.llm import common, embedding_dedup, pipeline, quality


def test_training_rows_are_bounded_by_id(spark, monkeypatch):
    rows = [(1, f"word{i} and more words") for i in range(300)] + [(i, "some other text") for i in range(2, 12)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    table, found = quality.features(docs, labels, quality.SAMPLE)
    assert 10 < len(found) <= 10 + 16 and quality.SAMPLE == 3000
    rows = table.collect()
    assert sorted((r.id, r.text_hash) for r in rows) == sorted((r.id, r.text_hash) for r in found) and all(len(r.cells) == len(r.shares) == 4 * r.n for r in rows)
    assert max(np.frombuffer(r.cells, np.int32).max() for r in rows) < 3 << 16
    monkeypatch.setattr(quality, "SAMPLE_CELLS", 150)
    part, few = quality.features(docs, labels, quality.SAMPLE)
    assert few == found[: len(few)] and 0 < sum(r.n for r in few) <= 150 < sum(r.n for r in found[: len(few) + 1]) and part.count() == len(few)


def test_tasks_vectors_are_summed_before_the_driver_gets_them(spark, monkeypatch):
    size = 25_000
    table = spark.range(40).select("id", F.lit(0).cast("long").alias("text_hash")).repartition(7)
    frame, got = type(table), []
    monkeypatch.setattr(frame, "collect", lambda self, plain=frame.collect: got.extend(found := plain(self)) or found)
    total = quality.summed(table, lambda batch: np.arange(size) * float(sum(batch.column("id").to_pylist())), size)
    assert (total == np.arange(size) * sum(range(40))).all()
    assert sum(len(r.total) for r in got) == 8 * size
    assert (quality.summed(table.limit(0), lambda batch: np.ones(size), size) == np.zeros(size)).all()


def test_tasks_sum_up_every_row(spark, monkeypatch):
    """The fit over many files and small blocks is that over one, and its sums are those of brute force."""
    rows = [(i, None if i == 7 else f"a{i} b{i % 3} c") for i in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    whole = quality.fit(docs, labels)
    again = quality.fit(docs, labels)
    assert all(np.array_equal(a, b) for a, b in zip(whole, again, strict=True))
    monkeypatch.setattr(quality, "FILE_CELLS", 50)
    parts = quality.fit(docs, labels)
    assert np.allclose(whole.weights, parts.weights, rtol=1e-4, atol=1e-6) and abs(whole.bias - parts.bias) < 1e-6
    table, found = quality.features(docs, labels, 3000)
    assert table.rdd.getNumPartitions() > 1
    got = quality.summed(table, lambda batch: sum(np.bincount(col, val, 3 << 16) for _, col, val, _ in quality.blocks(batch)), 3 << 16)
    want = np.zeros(3 << 16)
    for r in table.collect():
        want[np.frombuffer(r.cells, np.int32)] += np.frombuffer(r.shares, np.float32)
    assert np.allclose(got, want) and len(found) == 40


def test_minimise():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 12)), rng.normal(size=30)
    least = np.linalg.lstsq(a, b, rcond=None)[0]
    got = quality.minimise(lambda x: (((a @ x - b) ** 2).sum() / 2, a.T @ (a @ x - b)), 12, 60)
    assert np.allclose(got, least, atol=1e-4) and not quality.minimise(lambda x: (0.0, x * 0), 3).any()


@pytest.mark.parametrize("per_cell", [embedding_dedup.PER_CELL, 2])  # 2: a grid of 38 x 38 cells
def test_links_count_for_both_ends(spark, monkeypatch, per_cell):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    assert embedding_dedup.codewords(3000) == (16 if per_cell > 2 else 38)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y[:, 8:] = 0  # neighbours that differ in one half only
    y -= (y * x).sum(1)[:, None] * x
    c = rng.uniform(0.88, 0.96, len(x))[:, None]
    v = np.concatenate([x, c * x + np.sqrt(1 - c**2) * y / np.linalg.norm(y, axis=1)[:, None], x[:40]])
    got = {r.vec_id: r for r in embedding_dedup.op7(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    n = np.array([got[i].n_links for i in range(len(u))])
    alone = [(i, j) for i, j in np.argwhere(close) if close[i].sum() == close[j].sum() == 1]
    assert len(alone) > 500 and all(n[i] == n[j] for i, j in alone)
    assert (n <= close.sum(1)).all() and n.sum() % 2 == 0 and n.sum() >= 0.985 * close.sum()
    # where all links of a class are found, its members are those of the brute force
    label = np.arange(len(u))
    for _ in range(40):
        label = np.array([label[row].min(initial=label[i]) for i, row in enumerate(close)])
    whole = [i for i in range(len(u)) if all(n[j] == close[j].sum() for j in np.flatnonzero(label == label[i]))]
    assert len(whole) > 0.97 * len(u) and all(got[i].component_id == label[i] for i in whole)


def test_codewords_are_the_same_in_blocks(monkeypatch):
    x = np.random.default_rng(5).normal(size=(500, 8))
    whole = embedding_dedup.kmeans(x, 20)
    for held in (20 * 7, 1):  # seven vectors at a time, and one
        monkeypatch.setattr(embedding_dedup, "DISTANCES", held)
        assert np.allclose(embedding_dedup.kmeans(x, 20), whole) and len(whole) == 20


def test_rows_that_share_a_vec_id(spark):
    """Rows of one vec_id are one node that joins the classes of all its vectors; each row keeps its own links."""
    e = np.eye(4)
    rows = [(5, e[0]), (5, e[1]), (9, e[0]), (3, e[1] + 0.1 * e[2]), (7, e[3]), (7, e[3]), (8, -e[3])]
    got = embedding_dedup.op7(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 1, 3, False)]


def test_visits_follow_true_pairs():
    assert embedding_dedup.visits_for({1: 90, 4: 9, 200: 1}, 0.99) == 4 and embedding_dedup.visits_for({1: 90, 4: 8, 200: 2}, 0.99) == 200 and embedding_dedup.visits_for({}, 0.99) == 1


def test_rows_of_clashing_columns_and_long_texts(spark):
    """Columns that are named like an operator's own pass through, and very long rows are judged as a whole."""
    names = ["n_words", "word_chars", "kept", "base_failed", "quality", "cell", "hash", "id", "good", "text_hash"]
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, "short"), (3, "again and again " * 100), (4, None), (5, " ".join(f"x{i % 97}y{i}" for i in range(300))), (5, "other text of the same id " + " ".join(f"v{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(c.upper()).alias(c) for c in names])
    labels = spark.createDataFrame([(1, 1, "a"), (2, 0, "b"), (3, 0, "c"), (5, 1, "d")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = [(r.doc_id, r.n_words, r.base_failed) for r in quality.op6(docs, labels).collect()]
    assert sorted(got) == [(1, 400_000, False), (2, 1, True), (3, 300, True), (4, 0, True), (5, 46, False), (5, 300, False)]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and all(r.n_words == "N_WORDS" and r.kept == "KEPT" for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} <= {1, 5}


def test_pipeline_of_nothing(spark, tmp_path):
    """An empty table, and one of which all documents are dropped, pass all stages with their columns."""
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    for case, rows in (("empty", []), ("dropped", [(1, "too short", "a", "en", 9), (2, None, None, None, None), (2, "", "b", "en", 0)])):
        d = f"{tmp_path}/{case}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in pipeline.STAGES[:-1]:
            before, docs = docs, common.scratch(stage(spark, docs, d), name)
            assert docs.columns == before.columns and docs.count() == 0, (case, name)
        assert pipeline.run(spark, d).count() == 0


def test_scratch_tables_of_a_run_go(spark):
    with common.scratch_run(spark) as path:
        table = common.scratch(spark.range(10), "numbers")
        assert table.count() == 10 and os.listdir(path)
    assert not os.path.exists(path)
    assert common.scratch(spark.range(3), "numbers").count() == 3


def test_chunks_of_texts_have_the_ids_of_the_whole_texts(monkeypatch):
    """Awkward Latin-1 texts, other texts among them, control strings, and a memory that is too small for a chunk's pieces."""
    import glob
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from viewgrade.llm import kernels, packing

    rng = random.Random(6)
    bits = ["a", "B", "'", "'s", "'t", "'re", "'LL", "'d", "'ve", "'r", " ", "\n", "\x85", "\xa0", "1", "23", "²", "¼", "ª", "ß", "À", "×", "ÿ", ",", "!!", "<|", "|>", "\x1c", "Ω", "中", "é", "😀", "İ", "\x00", "¿", "don't", "re", "ll"]
    texts = ["".join(rng.choice(bits[: 25 if i % 3 else None]) for _ in range(rng.randint(0, 40))) for i in range(1500)] + [None, "", "'", "x's", "'s", "<", "|", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    files = [f for f in glob.glob(f"{os.path.dirname(packing.vocabulary_path())}/*.json") if '"model"' in open(f, encoding="utf-8").read()]
    for remembered in (packing.REMEMBERED, 3):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        for file in files if remembered > 3 else [packing.vocabulary_path()]:
            whole, own, at = Tokenizer.from_file(file), packing.Encoder(file), 0
            for lo, hi, data, offs in kernels.text_chunks(batch, size=4000):
                ids, borders = own.rows(data, offs)
                for r in range(lo, hi):
                    assert ids[borders[r - lo] : borders[r - lo + 1]].tolist() == whole.encode(texts[r] or "", add_special_tokens=False).ids, (file, texts[r])
                at = hi
            assert at == len(texts)


def test_packing_of_long_texts_and_clashing_columns(spark):
    from viewgrade.llm import packing

    names = ("h", "piece", "start", "length", "bucket", "sequence_id", "offset", "ids", "n", "rank")
    long = " ".join(f"w{i % 997}é" for i in range(400_000))  # longer than two chunks
    docs = spark.createDataFrame([(1, long), (2, None), (3, "some words"), (3, "some words")], "doc_id long, text string")
    plain = sorted(tuple(r)[:5] for r in packing.op2(docs).collect())
    assert plain == sorted(tuple(r)[:5] for r in packing.op2(docs.withColumns({c: F.lit("x") for c in names})).collect())
    sizes = [r[3] for r in plain if r[0] == 1]
    assert len(long.encode()) > 2 * packing.CHUNK and sizes[:-1] == [packing.ROOM] * (len(sizes) - 1) and [r[2] for r in plain if r[0] == 1] == [packing.ROOM * i for i in range(len(sizes))]
