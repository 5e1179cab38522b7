"""Text operators (1, 2, 5, 6, 8, 10) and the pipeline against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewgrade.llm import common, mixing, ngram_join, packing, quality, repeats, substring_dedup, suffix_dedup

SPACE = r"[^\x20\x09-\x0D]+"
LOWEST = -(1 << 63)


def words(text):
    return re.findall(SPACE, text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, a chain of edits, shared passages, hot words, nulls and blanks."""
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(lexicon) for _ in range(n))

    def edit(t, m):
        w = t.split(" ")
        for _ in range(m):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        return " ".join(w)

    base = [text(rng.randint(40, 300)) for _ in range(12)]
    passage = text(90)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 3]) for i in range(20)]
    out += [(200 + i, edit(base[i % 5], rng.randint(1, max(1, len(base[i % 5].split(" ")) // 40)))) for i in range(40)]
    chain = text(200)
    for i in range(15):
        chain = edit(chain, 4)
        out.append((300 + i, chain))
    out += [(400 + i, text(rng.randint(5, 60)) + " " + passage + "\n" + text(20)) for i in range(15)]
    out += [(500, None), (501, ""), (502, " \n\t"), (503, "a " * 300), (504, "a " * 250), (505, "A b c d"), (506, "a b  c\nd"), (507, "a b c d e"), (508, base[4] + " " + base[4]), (509, "é" * 450), (510, "é" * 300), (None, base[7]), (511, text(4000) + passage), (600, base[8]), (600, base[8])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumn("_starts", F.lit(1)).withColumn("_h", F.lit(2)).withColumn("_doc", F.lit("clash")).repartition(5)


def unique(rows):
    """Repeated rows count as one document."""
    return list(dict.fromkeys(rows))


def test_suffix_dedup(rows, docs, monkeypatch):
    length, seen = 400, Counter()
    for _, t in unique(rows):
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[d, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    for block in (repeats.BLOCK, 1):  # 1: every anchor in blocks
        monkeypatch.setattr(repeats, "BLOCK", block)
        got = suffix_dedup.op1(docs).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        whole = [r for r in got if "\ufffd" not in r.kept_text]
        assert len(whole) > 50 and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in whole)
    assert sum(k[2] > 0 for k in want) > 20


def test_two_stage_sorting():
    rng = np.random.default_rng(2)
    for size, symbols in ((1, 1), (2, 1), (50, 2), (300, 3), (2000, 200)):
        text = rng.integers(1, 1 + symbols, size).astype(np.uint8)
        for wanted in (np.ones(size, bool), rng.random(size) < 0.3):
            got = suffix_dedup.two_stage(text, wanted, size)
            assert got.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:].tobytes())
            if len(got):
                shared = suffix_dedup.neighbours_share(text, got, 8)
                raw = text.tobytes()
                assert shared.tolist() == [len(raw) - max(i, j) >= 8 and raw[i : i + 8] == raw[j : j + 8] for i, j in zip(got[:-1].tolist(), got[1:].tolist(), strict=True)]


def substring_truth(rows, window=20):
    seen, want = set(), {}
    for _, d, t in sorted((LOWEST if d is None else d, d, t or "") for d, t in unique(rows)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[d, t] = (d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return want


def test_substring_dedup(rows, docs, monkeypatch):
    want = substring_truth(rows)
    for block in (repeats.BLOCK, 1):  # 1: every seed in blocks
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert Counter(map(tuple, substring_dedup.op10(docs).collect())) == Counter(want[d, t or ""] for d, t in rows)
    left = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    for (d, t), x in want.items():
        assert (d in left) == (x[2] == 0 or x[2] < x[1])
        if d in left and x[2]:
            assert hashlib.sha256(left[d].text.encode()).hexdigest() == x[3] and left[d].n_chars == len(left[d].text)
        elif d in left:
            assert (left[d].text or "") == t and left[d]._doc == "clash"


def test_a_thousand_surroundings_of_one_passage(spark):
    """One anchor with 1,000 different segments: half of them share some words more with one other document."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage, rows = " ".join(word() for _ in range(30)), []
    for i in range(1000):
        before, after = ([word() for _ in range(40)] for _ in range(2))
        if i % 2:
            m = rng.randint(0, 30)
            before[40 - m :] = last[0][40 - m :]
            after[: 30 - m] = last[1][: 30 - m]
        last = before, after
        rows.append((i, " ".join([*before, passage, *after])))
    for long in (rows, [(i, t.replace(passage, passage[:200])) for i, t in rows]):
        docs = spark.createDataFrame(long, "doc_id long, text string").repartition(6)
        want = substring_truth(long)
        assert Counter(map(tuple, substring_dedup.op10(docs).collect())) == Counter(want[r] for r in long)
        length, seen = 400, Counter()
        for _, t in long:
            seen.update({t[i : i + length] for i in range(len(t) - length + 1)})
        removed = {}
        for d, t in long:
            gone = bytearray(len(t))
            for i in range(len(t) - length + 1):
                if seen[t[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            removed[d] = sum(gone)
        assert {r.doc_id: r.n_removed for r in suffix_dedup.op1(docs).collect()} == removed and sum(x > 0 for x in removed.values()) > 100


def test_extension_compares_words():
    """Places that meet by a colliding hash part at their seed's words, whatever stands around them."""
    text = ["a b c d e f", "a b x d e f", "a b c d e g", "z b c d e f", "a b c d"]
    ids, borders = substring_dedup.word_ids(pa.array([x.encode() + b" " for x in text], pa.binary()))
    vocabulary = {w: i for w, i in zip(" ".join(text).split(), ids.tolist(), strict=True)}
    assert ids.tolist() == [vocabulary[w] for w in " ".join(text).split()] and len(set(ids.tolist())) == len(vocabulary)
    lower, key = borders[:-1], np.zeros(5, np.int64)  # one key for all, seeds of two words in the middle
    left, right = substring_dedup.extensions(key, lower + 2, lower, borders[1:], ids, 2, 2)
    groups = lambda c: sorted(sorted(np.flatnonzero(c == v).tolist()) for v in set(c.tolist()))
    assert groups(left[0]) == groups(right[0]) == [[0, 2, 3, 4], [1]]
    assert groups(left[2]) == [[0, 2, 4], [1], [3]] and groups(right[1]) == [[0, 2, 3], [1], [4]] and groups(right[2]) == [[0, 3], [1], [2], [4]]


def jaccard_truth(rows):
    sets = []
    for d, t in unique(rows):
        w = words(low(t))
        sets.append((LOWEST if d is None else d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    return {d: (len(s), None if least[root(i)] == LOWEST else least[root(i)]) for i, (d, s) in enumerate(sets)}


def test_ngram_jaccard_join(rows, docs, monkeypatch):
    want = jaccard_truth(rows)
    for few, stars in ((ngram_join.FEW, ngram_join.STARS), (0, ngram_join.STARS), (0, 0), (10**9, 1)):  # 0: stars first for every gram, no stars at all
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "STARS", stars)
        got = ngram_join.op5(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id) == want[LOWEST if r.doc_id is None else r.doc_id], r
    kept = ngram_join.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(d for d, _ in rows if want[LOWEST if d is None else d][1] == d)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(999, 1000 + i) for i in range(100)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    size = Counter(root(i) for i in parent)
    assert got == {i: root(i) for i in list(parent) if size[root(i)] > 1}


def base_rules(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    count, marked = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    n = len(marked)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def test_quality_rules(spark, rows, docs):
    more = [(700 + i, t) for i, t in enumerate(["x\nx\n\n \n \nx\r\nx", "a b\n" * 30, "#*$%&|<> é# ", "\n", "a\n\na\nb"])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality.op6(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((d, *base_rules(t)) for d, t in rows + more)
    assert all(r.kept != r.base_failed for r in got)


def test_quality_classifier_on_held_out_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        w = [rng.choice(["the", "of", "river", "stone", "light", "walks", "under", "house"]) for _ in range(60)]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        if i < 200:
            labels.append((i, int(good)))
    labels += [(None, 1), (5000, 0), (3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.quality_rules(docs, model).collect()}
    assert sum(got[i].kept == (i % 4 > 0) for i in range(200, 400)) >= 196
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, r in got.items() if r.kept}
    assert quality.op6(docs.limit(0), labels).count() == 0


def test_mixing(spark, docs):
    rng = random.Random(8)
    rows = [(i, rng.choice(["b", "a", "é", None, "z"] + ["a"] * 3), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for i in range(600)]
    rows += [(1, None, None), (None, "lonely", "x y"), (9002, "empty", ""), (5, "a", "r r r"), (5, "a", "r r r")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.op8(df).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * size[s] if s in capped else weight[s] * level for s in names}
    source_of = {r[0]: r[1] for r in rows if r[0] not in (1, 5)}
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        taken[round(r.target, 6)] += r.taken
        if r.doc_id in source_of:
            assert (r.source_size, round(r.target, 6)) == (size[source_of[r.doc_id]], round(target[source_of[r.doc_id]], 6))
    for t, n in taken.items():
        t = sum(x for x in target.values() if round(x, 6) == t)  # sources may share a target
        assert abs(n - t) <= max(6, 0.01 * t)
    for block in (1, 7, 100_000):  # the target, rounded down, at every size of block
        of = defaultdict(int)
        for r in mixing.mix_sources(df, block=block).collect():
            assert r.taken <= 3 * r.size
            of[r.target, r.source_size] += r.taken
        shared = Counter((target[s], size[s]) for s in names)
        assert all(abs(n - t * shared[min(shared, key=lambda k: (k[1] != z, abs(k[0] - t)))]) <= 2 for (t, z), n in of.items())
    assert sorted(map(str, mixing.op8(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.op8(df.limit(0)).count() == 0 and mixing.op8(df.where("doc_id = 9002")).first().taken == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = Counter()
    for r in mixed.collect():
        n[r.doc_id] += len(words(r.text))
    want = Counter()
    for r in mixing.op8(docs).collect():
        want[r.doc_id] += r.taken
    assert +n == +want


def test_packing_plan():
    rng = np.random.default_rng(9)
    for n in (0, 1, 40, 3000):
        lengths = np.minimum(4096, np.maximum(1, rng.lognormal(5.5, 1.3, n).astype(int)))
        histogram = dict(Counter(lengths.tolist()))
        plan, held = packing.pack(histogram), defaultdict(list)
        for length, count in histogram.items():
            for s, o in zip(*plan.place(np.full(count, length), np.arange(count)), strict=True):
                held[s].append((o, length))
        assert len(held) == plan.sequences <= max(1, -(-int(lengths.sum()) // 4096)) * 1.02 + 1
        for parts in held.values():
            at = 0
            for o, length in sorted(parts):
                assert o == at
                at += length
            assert at <= 4096


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 8)), np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    y = packing.nnls(a, rng.normal(size=20))
    assert (y >= 0).all()


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    more = [(800, "it's DON'T <|endoftext|>x\x1cy ŠΣς 12　ab  c"), (801, "é ́a"), (802, "ab " * 9000)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = packing.op2(df).collect()
    tokenizer, want = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for d, t in rows + more:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[d, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 4096
    assert packing.op2(df.limit(0)).count() == 0


def test_other_vocabularies_are_encoded_as_a_whole():
    import glob
    import os

    from tokenizers import Tokenizer

    files, known = glob.glob(f"{os.path.dirname(packing.vocabulary_path())}/*.json"), 0
    texts = ["it's DON'T  stop 123 abc\n\tx", "ŠΣς é ́a 12　ab", "", "a" * 100 + " b", "print(x) == 2"]
    for file in files:
        try:
            plain, encoder = Tokenizer.from_file(file), packing.Encoder(file)
        except Exception:  # noqa: BLE001, S112  not a file of this library
            continue
        known += encoder.known
        for t in texts:
            assert encoder.text(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), (file, t)
    assert known == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for f in (suffix_dedup.op1, ngram_join.op5, substring_dedup.op10):
        assert f(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(rng.randint(30, 200))) for _ in range(60)]
    passage = " ".join(rng.choice(lexicon) for _ in range(60))
    texts += [texts[i] for i in range(8)] + [t + " " + passage for t in texts[20:26]] + [" ".join(w.upper() + "$$$" for w in t.split(" ")) for t in texts[30:50]] + ["too short", None]
    rows = [(i, t, f"s{i % 4}", "en", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not (74 <= i < 94)), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.scratch(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert ids("quality_rules") == set(range(74))
    truth = jaccard_truth([(i, t) for i, t in enumerate(texts[:74])])
    assert ids("ngram_jaccard_join") == {i for i in range(74) if truth[i][1] == i}
    assert sum(passage in " ".join(words(r.text)) for r in seen["substring_dedup"].collect()) == 1
    assert ids("source_mixing") <= ids("substring_dedup")
    assert ids("best_fit_packing") == ids("source_mixing")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_suffix_filter_by_parts_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - e, replace=False), rng.integers(0, 1 << 63, e).astype(np.uint64)])) for e in (0, 5, 10, 20, 30, 40, 60, 150)]
    sets.append(np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64)))
    borders = np.cumsum([0, *map(len, sets)])
    counts = ngram_join.part_counts(np.concatenate(sets), borders)
    assert counts[-1] is None and None not in counts[:-1]
    known = np.array([c is not None for c in counts])
    parts = np.frombuffer(b"".join(c or bytes(ngram_join.PARTS) for c in counts), np.uint8).reshape(len(sets), -1)
    i, j = np.triu_indices(len(sets), 1)
    passed = ngram_join.parts_reach(parts, known, np.diff(borders), i, j, 80)
    linked = [100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert any(linked) and passed[np.array(linked)].all() and not passed.all()
    assert passed[j == len(sets) - 1].all()
