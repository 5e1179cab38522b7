"""Joins and validations of the dataset flow against brute force."""

import random

from pyspark.sql import functions as F

from viewgrade.operators import relational as R


def test_suffixes_of_hundreds_of_lengths(spark):
    """Stems of 500 lengths, nested ones, an empty one, ties, and images in later ranges than their stems."""
    rng = random.Random(4)
    base = "".join(rng.choice("ab/é") for _ in range(900))
    images = [base[rng.randint(0, 300) :] for _ in range(60)] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["b", "", None, "b"]
    stems = [base[-n:] for n in range(1, 501)] + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)] + [None, "zz", "ab"]
    rng.shuffle(stems)
    prompts = [(i, s, f"p{i}") for i, s in enumerate(stems)]
    want = {}
    for image in images:
        if image is not None and (own := [p for p in prompts if p[1] is not None and image.endswith(p[1])]):
            want[image] = min(own)[2]
    df, at = spark.createDataFrame([(i,) for i in images], "image string"), spark.createDataFrame(prompts, "ord long, stem string, prompt string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.image: r.prompt for r in R.first_suffix_match(df, at).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    everywhere = spark.createDataFrame([(0, "", "all"), (1, "b", "late")], "ord long, stem string, prompt string")
    assert {r.prompt for r in R.first_suffix_match(df, everywhere).collect()} == {"all"}
    assert R.first_suffix_match(df.limit(0), at).count() == 0 and R.first_suffix_match(df, at.limit(0)).count() == 0
