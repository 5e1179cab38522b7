"""Operators 11, 12 and 13 against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewgrade.llm import decontaminate, hard_negatives, spelling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = r"[A-Za-zÀ-ÿ]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def extra(df):
    """Columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("n", "word", "words", "window", "pattern", "h1", "key", "score", "anchor", "own")})


# --- 11


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abcéx1") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, text(rng.randint(10, 40))) for i in range(30)] + [(50, "Éa é"), (51, None), (52, " .,\n"), (53, "solo"), (54, ""), (55, text(10)), (3, text(15)), (None, text(12)), (10, "a a a a a a a a a a a"), (60, "tail of the first"), (61, "tail of the first")]
    by = dict(items)
    docs = [(i, text(rng.randint(0, 200))) for i in range(30)]
    docs += [(100 + i, f"{text(5)}, {(by[i] or '').upper()}! {text(rng.randint(0, 9))}") for i in range(30)]
    docs += [(200, by[0]), (200, by[0]), (201, None), (202, ""), (203, by[1] * 2), (204, "a " * 40), (None, by[2]), (205, " ".join(by[4].split(" ")[:9])), (206, f"{by[55]} {by[55]}"), (207, "SOLO.Tail-of the\tfirst"), (208, items[-4][1]), (209, "éa é Éa É")]
    docs.append((300, f"{text(150_000)} {by[5]} {text(150_000)}"))  # longer than one chunk
    return docs, items


def contaminated(docs, items, width=10):
    patterns = defaultdict(set)
    for i, t in items:
        w = tuple(re.findall(WORD, low(t)))
        for p in range(max(1, len(w) - width + 1) if w else 0):
            patterns[w[p : p + width]].add(i)
    sizes = {len(p) for p in patterns}
    for doc, t in docs:
        w = tuple(re.findall(WORD, low(t)))
        hit, found = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if w[p : p + k] in patterns:
                    hit.update(range(p, p + k))
                    found |= patterns[w[p : p + k]]
        names = sorted(str(i) for i in found - {None})
        yield doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 4000])
def test_windows_of_items(spark, monkeypatch, texts, block_bytes):
    docs, items = texts
    monkeypatch.setattr(decontaminate.contamination, "__defaults__", (decontaminate.WIDTH, block_bytes))
    got = decontaminate.op11(extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), extra(spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, contaminated(docs, items)))


def test_spans_and_items(spark):
    docs = spark.createDataFrame([(1, "x One two three x one two y")], "doc_id long, text string")
    items = spark.createDataFrame([("b", "one two three"), ("a", "one two")], "item_id string, text string")
    row = decontaminate.contamination(docs, items, 2).first()
    assert [tuple(s) for s in row.spans] == [(1, 4), (5, 7)] and row["items"] == ["a", "b"]


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.op11(docs.limit(0), items).count() == 0
    row = decontaminate.op11(docs, items.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_colliding_hashes_are_compared(spark, monkeypatch):
    """Words of one hash are told apart by their bytes, in whatever bucket they meet."""
    monkeypatch.setattr(decontaminate.K, "word_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    found = decontaminate.compile_patterns(["ab cd ef", "ab cd eg", "q"], np.array([7, 8, 9]))
    data = np.frombuffer(b"ab cd eg ab cd eh q", np.uint8)
    start, end, borders = decontaminate.K.words(data, np.array([0, len(data)]))
    hits = [(int(f), int(n)) for p in found for f, n in zip(*p.search(data, start, end, (end - start).astype(np.uint64), borders), strict=True)]
    assert sorted(hits) == [(0, 8), (6, 9)]


# --- 12


def negatives(rows):
    good = [(i, (c + 1) % 10 if i % 7 == 0 else c, [int(np.floor(256 * float(x))) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, c, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in good if j != i and len(w) == len(v))
            for s, j, d in [x for x in scored if x[2] == c][:5]:
                fits = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                yield from ((i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, int(rng.integers(0, 10)), (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)]
    ties = [(2000 + i, i % 3, [0.5] * 8 + [0.0] * 8) for i in range(40)]  # equal scores
    odd = [(3000, 1, None), (3050, None, [0.1] * 16), (3100, 1, [0.1] * 15 + [None]), (3150, 1, [0.1] * 15 + [float("nan")]), (3200, 1, [0.1] * 15 + [float("inf")]), (None, 1, [0.2] * 16), (3250, 2, [0.1] * 4), (3300, 2, [0.1, -0.1, 0.1, 0.2]), (3301, 3, [0.1, -0.1, 0.1, 0.1]), (3350, 1, []), (3400, 3, [0.0] * 16), (50000, 77, [1.0] * 16)]
    return rows + ties + odd + rows[7:9] + rows[101:102]


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 1500])
def test_hard_negatives(spark, monkeypatch, vectors, anchor_bytes):
    monkeypatch.setattr(hard_negatives.hard_negatives, "__defaults__", (50, anchor_bytes))
    df = extra(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")).repartition(3)
    assert sorted(map(tuple, hard_negatives.op12(df).collect())) == sorted(negatives(vectors))


def test_intervals_drop_pairs_and_hold_scores():
    rng = np.random.default_rng(2)
    a, v = rng.integers(-90, 90, (20, 32)), rng.integers(-90, 90, (300, 32))
    side, planes = hard_negatives.Side(np.arange(20), np.arange(20), np.zeros(20), a), hard_negatives.planes_of(v)
    assert len(planes) == 8 and (sum(w * p for w, p in planes) == v).all()
    true, seen = a @ v.T, []

    def wanted(own, low, high):
        seen.append(low.size)
        if low.ndim == 2:
            assert (low <= true).all() and (true <= high).all()
        return high >= 60_000

    i, j, score = hard_negatives.sliced(side, np.arange(20), v, planes, wanted, np.ones((20, 300), bool))
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == {(x, y) for x, y in np.argwhere(true >= 60_000).tolist()} and (score == true[i, j]).all()
    assert seen[0] == 6000 and seen[-1] < 600  # few pairs go through the last planes


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.op12(df.limit(0)).count() == 0 and hard_negatives.op12(df).count() == 0  # no rows, no anchors
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.op12(spark.createDataFrame([(50, 1, [1e8, 1e8]), (51, 1, [1e8, 1e8])], "vec_id long, label int, embedding array<double>")).collect()


# --- 13


def spelled(docs):
    n = Counter()
    for doc, t in docs:
        for run in re.findall(LETTERS, low(t)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: m for w, m in n.items() if len(w) >= 7 and m >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: sorted((-n[x], x) for x in n if near(w, x)) for w in n}
    form = {w: o[0][1] if o and -o[0][0] >= 10 * n[w] else None for w, o in others.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None


def test_spelling_variants(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(6)] + ["aaaaaaaa", "éééééééÿ", "abcdefgh"]

    def typo(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w[:i] + rng.choice("abÀÿ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abÞé") + w[i + 1 :]])

    docs = []
    for i in range(400):
        words = [rng.choice(stems) if rng.random() < 0.8 else typo(typo(rng.choice(stems))) if rng.random() < 0.4 else typo(rng.choice(stems)) for _ in range(30)]
        docs.append((i, rng.choice([" ", ", ", "1", "\n", "Ā", "—"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    chain = [("abcdefg", 1000), ("abcdefgx", 100), ("abcdefgxy", 10)]  # forms of forms
    docs += [(1000, None), (1001, ""), (1002, "12 ab é"), (None, "abcdefgh abcdefgh aaaaaaaa"), (7, docs[7][1]), (-5, "bcdefghi " * 50), (1003, " ".join(f"{w} " * m for w, m in chain))]
    docs.append((2000, ("Abcdefgh " * 70_000) + "x" * 600_000 + " bcdefghi"))  # longer than one chunk
    got = spelling.op13(extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)).collect()
    want = sorted(map(str, spelled(docs)))
    assert sorted(map(str, map(tuple, got))) == want and sum(r.root != (r.form or r.word) for r in got) > 0


def test_spelling_of_an_empty_table_and_bounded_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"wordone{c} wordone{c}" for c in "abcdefgh")) for i in range(50)], "doc_id long, text string").coalesce(1)
    assert spelling.op13(docs.limit(0)).count() == 0
    whole = sorted(map(tuple, spelling.op13(docs).collect()))
    monkeypatch.setattr(spelling, "HELD", 3)
    assert sorted(map(tuple, spelling.op13(docs).collect())) == whole and whole


@pytest.mark.parametrize("data", [b"", b"a", b"1:abcdefgh", "9:ÀÿÉ".encode()])
def test_crc32(data):
    buffer = np.frombuffer(data + b"abc", np.uint8)
    start = np.array([zlib.crc32(b"1:"), zlib.crc32(b"")], np.uint32)
    assert spelling.crc32(start, buffer, np.array([0, 1]), np.array([len(data), len(data) + 2])).tolist() == [zlib.crc32(b"1:" + data), zlib.crc32((data + b"abc")[1 : len(data) + 2])]
