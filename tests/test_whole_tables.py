"""Registered queries over whole texts and all rows, against brute force on small tables."""

import math
import random
from collections import Counter

from viewgrade.dims import DISTORTIONS
from viewgrade.plans import registry


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def bleu(a, b):
    logs = []
    for n in range(1, 5):
        x, y = grams(a, n), grams(b, n)
        total, hit = sum(y.values()), sum((x & y).values())
        share = 0.0 if not x or not total else hit / total if hit else 1 / (total + 1)
        logs.append(math.log(max(share, 1e-10)))
    return min(1.0, (1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b))) * math.exp(sum(logs) / 4))


def cider(a, b):
    x, y = (sum((grams(w, n) for n in range(1, 5)), Counter()) for w in (a, b))
    idf = lambda g: 1.0 if g in x and g in y else 1 + math.log(1.5)
    norm = lambda v: math.sqrt(sum((n * idf(g)) ** 2 for g, n in v.items()))
    return 10 * sum(n * y[g] for g, n in x.items()) / (norm(x) * norm(y))


def test_similarity_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    turns = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (90, 130, 45, 70)]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {q: {r.turn: r for r in registry.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("bleu", "rouge_l", "cider", "cognitive_scores")}
    for i, (a, b) in enumerate(zip(map(str.split, turns), map(str.split, turns[1:]), strict=False)):
        r = got["bleu"][i]
        assert (r.n_ref, r.n_hyp, r.bigram_hits) == (len(a), len(b), sum((grams(a, 2) & grams(b, 2)).values())) and abs(r.bleu - bleu(a, b)) < 2e-6
        common = lcs(a, b)
        assert got["rouge_l"][i].lcs == common and abs(got["rouge_l"][i].rouge_l - 2 * common / (len(a) + len(b))) < 2e-6
        assert abs(got["cider"][i].cider - cider(a, b)) < 2e-5
        assert abs(got["cognitive_scores"][i].plain - bleu(a, b) - 2 * common / (len(a) + len(b)) - 0.1 * cider(a, b)) < 2e-6


def test_every_entry_is_scored_and_expanded(spark, tmp_path):
    spark.createDataFrame([(i, i % 5, 1.0, "view") for i in range(40)], "event_id long, user_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    scored = registry.QUERIES["constant_scorer"](spark, str(tmp_path)).collect()
    assert sorted((r.sample_id, r.score) for r in scored) == [(i, 0.5) for i in range(40)]
    expanded = registry.QUERIES["expanded_questions"](spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.distortion) for r in expanded) == sorted((i, x) for i in range(40) for x in DISTORTIONS)
