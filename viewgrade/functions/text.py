"""Text similarity.

Token work is linear in Arrow functions (n-gram counts, longest common subsequence, CIDEr of one row's references); the
scores are Column expressions of what they return.  A corpus's idf is a grouped aggregate.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..dims import WEIGHTS
from ..session import stage


def tokens(text: Column) -> Column:
    """Lower-cased runs of non-blanks, with all Unicode blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    """Contiguous n-grams, joined by a blank (which no token has)."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


MOST = 4
HITS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("n_ref", "n_hyp", "hits")]))


def _counts(words, n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


#: Rows whose tokens a task holds as Python objects at a time; the rest of a batch stays in Arrow's buffers.
HELD = 64


def by_rows(*columns: pa.Array) -> Iterator[tuple]:
    """Rows of a batch as Python values, some at a time."""
    for i in range(0, len(columns[0]), HELD):
        yield from zip(*(c.slice(i, HELD).to_pylist() for c in columns), strict=True)


@F.arrow_udf(HITS)
def gram_hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For orders 1 to 4: n-grams of both sides, and how many of hyp's ref has, each at most as often as in ref."""
    for ref, hyp in batches:
        out = array("i")
        for a, b in by_rows(ref, hyp):
            for n in range(1, MOST + 1):
                x, y = _counts(a or [], n), _counts(b or [], n)
                out.extend((x.total(), y.total(), sum(min(k, x[g]) for g, k in y.items() if g in x)))
        numbers = np.frombuffer(out, np.int32).reshape(-1, 3) if out else np.empty((0, 3), np.int32)
        orders = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in numbers.T], ["n_ref", "n_hyp", "hits"])
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, MOST, dtype=np.int32)), orders)


def bleu(ref: Column, hyp: Column, smooth: bool = True) -> Column:
    """T4, of token arrays.  A precision of 0 is smoothed, and every precision is at least 1e-10."""
    hits = gram_hits(ref, hyp)

    def log_of(h: Column) -> Column:
        floor = 1 / (h["n_hyp"] + 1) if smooth else F.lit(0.0)
        precision = F.when((h["n_ref"] == 0) | (h["n_hyp"] == 0), F.lit(0.0)).when(h["hits"] == 0, floor).otherwise(h["hits"] / F.nullif(h["n_hyp"], F.lit(0)))
        return F.log(F.greatest(precision, F.lit(1e-10)))

    mean = F.aggregate(F.transform(hits, log_of), F.lit(0.0), lambda s, v: s + v) / F.size(hits)
    n_ref, n_hyp = hits[0]["n_ref"], hits[0]["n_hyp"]  # of single words
    short = F.when(n_hyp > n_ref, F.lit(1.0)).otherwise(F.exp(1 - n_ref / F.greatest(n_hyp, F.lit(1))))
    return F.when(n_hyp == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), short * F.exp(mean)))


def _lcs(a: list, b: list) -> int:
    """Bit-parallel: one bit for each word of b, and an addition and a mask for each word of a.

    Cleared bits mark where a common subsequence of the words so far grows by one, so their number is its length.
    """
    if len(a) > len(b):
        a, b = b, a
    at: dict = {}
    for j, y in enumerate(b):
        at.setdefault(y, []).append(j)
    masks = {}
    for y in set(a) & at.keys():
        bits = bytearray(len(b) // 8 + 1)
        for j in at[y]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[y] = int.from_bytes(bits, "little")
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if (mask := masks.get(x)) is not None:
            met = row & mask
            row = (row + met | row - met) & full
    return len(b) - row.bit_count()


@F.arrow_udf(IntegerType())
def lcs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Length of the longest common subsequence of two token arrays."""
    for a, b in batches:
        yield pa.array([_lcs(x, y) if x is not None and y is not None else 0 for x, y in by_rows(a, b)], pa.int32())


def rouge_l(common: Column, ref: Column, hyp: Column, beta: float = 1.0) -> Column:
    """T5, from the common length; 0 where either side is empty or nothing is common."""
    recall, precision = common / F.nullif(F.size(ref), F.lit(0)), common / F.nullif(F.size(hyp), F.lit(0))
    value = (1 + beta * beta) * recall * precision / F.nullif(recall + beta * beta * precision, F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def bag(words: Column, most: int = MOST) -> Column:
    """All n-grams of orders 1..most in one bag."""
    return F.concat(*[ngrams(words, n) for n in range(1, most + 1)])


@F.arrow_udf(DoubleType())
def cider_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """T8 without a corpus: mean tf-idf cosine of hyp (tokens) with each of its references (lists of tokens), times 10.

    The documents of the idf are the references and hyp; the cosine loses the tf denominators.
    """
    for refs, hyps in batches:
        out = []
        for many, hyp in by_rows(refs, hyps):
            bags = [sum((_counts(w, n) for n in range(1, MOST + 1)), Counter()) for w in [*(many or []), hyp or []]]
            df = Counter(g for x in bags for g in x)
            weighed = [{g: k * (math.log((len(bags) + 1) / (df[g] + 1)) + 1) for g, k in x.items()} for x in bags]
            norms = [math.sqrt(sum(v * v for v in x.values())) for x in weighed]
            h, found = weighed[-1], []
            for x, norm in zip(weighed[:-1], norms, strict=False):
                found.append(sum(v * x[g] for g, v in h.items() if g in x) / (norm * norms[-1]) if norm and norms[-1] else 0.0)
            out.append(10 * sum(found) / len(found) if found and h else 0.0)
        yield pa.array(out, pa.float64())


def cider(ref: Column, hyp: Column) -> Column:
    """T8 for one reference."""
    return cider_of(F.array(ref), hyp)


def tf_idf(documents: DataFrame, key: str = "doc", words: str = "tokens", most: int = MOST) -> DataFrame:
    """Key, gram, tf_idf for all n-grams of orders 1..most, pooled; idf over all documents, empty ones included."""
    grams = documents.select(key, F.explode(bag(F.col(words), most)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("c"))
    total = grams.groupBy(key).agg(F.sum("c").alias("total"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = documents.count()
    return grams.join(df, "gram").join(total, key).select(key, "gram", (F.col("c") / F.col("total") * idf(F.lit(n), F.col("df"))).alias("tf_idf"))


def cider_of_corpus(hyps: DataFrame, corpus: DataFrame, most: int = MOST, rows: int = 1 << 20) -> DataFrame:
    """T8 with a corpus: hyp_id, cider, the mean over all its documents, times 10.

    ``hyps`` (hyp_id, tokens) and ``corpus`` (doc_id, tokens).  The documents of a hypothesis' idf are the corpus and it
    itself, so a gram of its own is in one more.  The products are those of blocks of hypotheses with blocks of documents, of
    about ``rows`` grams each, so a gram that every text has meets no more than a block in a task, and only sums by hypothesis
    leave it.  Documents that share nothing count by their number only.
    """
    count = lambda texts, key: texts.select(key, F.explode(bag(F.col("tokens"), most)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # rows have numbers of their own, whatever the type of their ids
    numbered = lambda texts, key, *columns: stage(texts.select(*columns, "tokens", F.monotonically_increasing_id().alias(key)), key)
    hyps, corpus = numbered(hyps, "hyp", "hyp_id"), numbered(corpus, "doc")
    n = corpus.count()
    docs, own = count(corpus, "doc"), count(hyps, "hyp")
    known = stage(docs.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("id", F.monotonically_increasing_id()), "grams")
    plain, more = (F.log((n + 2) / (F.coalesce("df", F.lit(0)) + k)) + 1 for k in (1, 2))
    docs = stage(docs.join(known, "gram").select("doc", "id", "c", plain.alias("w")), "documents")
    own = stage(own.join(known, "gram", "left").select("hyp", "id", "c", more.alias("w")), "hypotheses")
    norm = own.groupBy("hyp").agg(F.sqrt(F.sum(F.col("c") * F.col("c") * F.col("w") * F.col("w"))).alias("norm"))
    met = own.where("id IS NOT NULL")
    across, down = (max(1, -(-x.count() // rows)) for x in (met, docs))
    block = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = met.withColumn("_h", block("hyp", across)).withColumn("_d", every(down)).groupBy("_h", "_d")
    right = docs.withColumn("_d", block("doc", down)).withColumn("_h", every(across)).groupBy("_h", "_d")
    sums = left.cogroup(right).applyInArrow(_block_sums, "hyp long, s double").groupBy("hyp").agg(F.sum("s").alias("s"))
    found = hyps.select("hyp_id", "hyp").join(sums.join(norm, "hyp"), "hyp", "left")
    return found.select("hyp_id", (10 * F.coalesce(F.col("s") / F.col("norm"), F.lit(0.0)) / n if n else F.lit(0.0)).alias("cider"))


def _block_sums(own: pa.Table, docs: pa.Table) -> pa.Table:
    """hyp, s: over a block's documents, the sums of products divided by the documents' norms for the hypothesis."""
    if not own.num_rows or not docs.num_rows:
        return pa.table({"hyp": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    docs, own = docs.sort_by("id"), own.sort_by("hyp")
    gram, c, w = (docs.column(x).to_numpy() for x in ("id", "c", "w"))
    doc = np.unique(docs.column("doc").to_numpy(), return_inverse=True)[1]
    base = np.bincount(doc, (c * w) ** 2)
    wanted, h, wh = (own.column(x).to_numpy() for x in ("id", "c", "w"))
    low = np.searchsorted(gram, wanted)
    many = np.searchsorted(gram, wanted, "right") - low
    hyp = own.column("hyp").to_numpy()
    heads = np.append(np.flatnonzero(np.append(True, np.diff(hyp) != 0)), len(wanted))
    out = []
    for a, b in zip(heads, heads[1:], strict=False):
        size = many[a:b]
        at = np.repeat(low[a:b] - np.cumsum(size) + size, size) + np.arange(size.sum())
        weight, amount = np.repeat(wh[a:b] ** 2, size), np.repeat(h[a:b], size)
        dot = np.bincount(doc[at], amount * c[at] * weight, len(base))
        # the document's own square changes where the hypothesis has its gram, too
        norm = base + np.bincount(doc[at], c[at] ** 2 * (weight - w[at] ** 2), len(base))
        some = dot > 0
        out.append(float((dot[some] / np.sqrt(norm[some])).sum()))
    return pa.table({"hyp": hyp[heads[:-1]], "s": pa.array(out, pa.float64())})


def cosine(x: Column, y: Column) -> Column:
    """T7, of two equally long arrays; 0 where a norm is 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0)), F.lit(0.0))


def combined(b: Column, r: Column, c: Column, normalised: bool = True, weights=WEIGHTS) -> Column:
    """Weighted sum of the three similarities, over the weights' sum unless asked not to."""
    total = b * weights[0] + r * weights[1] + c * weights[2]
    return total / sum(weights) if normalised else total


def against_truth(dist: Column, ref: Column) -> Column:
    """How much of the clean answer's similarity to the truth is left, within 0 and 1."""
    return F.least(F.greatest(dist / F.greatest(ref, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))


def map_cosine(x: Column, y: Column) -> Column:
    """T7 of two maps from key to weight, over the union of their keys; 0 where a norm is 0."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda v: v.cast("double") * v)))
    # a key that one side lacks adds 0, so the products of the common keys are the dot product
    both = F.map_zip_with(x, y, lambda k, a, b: F.coalesce(a.cast("double") * b, F.lit(0.0)))
    return F.coalesce(total(F.map_values(both)) / F.nullif(norm(x) * norm(y), F.lit(0.0)), F.lit(0.0))


def similarities(rows: DataFrame, ref: str, hyp: str, prefix: str = "") -> DataFrame:
    """bleu, rouge_l and cider of two text columns."""
    t = rows.withColumn("_r", tokens(F.col(ref))).withColumn("_h", tokens(F.col(hyp)))
    t = t.withColumn("_c", lcs("_r", "_h")).withColumn(f"{prefix}cider", cider(F.col("_r"), F.col("_h"))).withColumn(f"{prefix}bleu", bleu(F.col("_r"), F.col("_h")))
    return t.withColumn(f"{prefix}rouge_l", rouge_l(F.col("_c"), F.col("_r"), F.col("_h"))).drop("_r", "_h", "_c")


def with_truth(rows: DataFrame, truth: str = "gt_answer", ref: str = "ref_answer", dist: str = "dist_answer", weights=WEIGHTS) -> DataFrame:
    """What of the clean answer's fidelity is left (metric 1), drift between the answers (metric 2).

    ``baseline_failed`` marks rows whose clean answer has nothing of the truth.  Figures are rounded half to even.
    """
    t = similarities(similarities(similarities(rows, truth, ref, "r_"), truth, dist, "d_"), ref, dist, "rd_")
    names, c = ("bleu", "rouge_l", "cider"), F.col
    kept = [against_truth(c(f"d_{n}"), c(f"r_{n}")) for n in names]
    raw = [F.bround(c(f"{side}_{n}"), 6).alias(f"raw_{n}_{side}_gt") for n in names for side in "rd"]
    one = [F.bround(x, 6).alias(f"metric1_{n}") for n, x in zip(names, kept, strict=True)]
    two = [F.bround(c(f"rd_{n}"), 6).alias(f"metric2_{n}") for n in names]
    return t.select(*rows.columns, *one, F.bround(combined(*kept, weights=weights), 6).alias("metric1"), *two, F.bround(combined(*[c(f"rd_{n}") for n in names], weights=weights), 6).alias("metric2"), (c("r_bleu") < 1e-6).alias("baseline_failed"), *raw)


def cognitive_scores(prompts: DataFrame, key: str, ref: str = "ref_text", dist: str = "dist_text", corpus: DataFrame | None = None, weights=WEIGHTS) -> DataFrame:
    """Key, bleu, rouge_l, cider (means over a key's prompts) and cognitive_score, rounded half to even.

    With ``corpus`` (doc_id, tokens) CIDEr is that of the corpus.  Prompts come as rows, so both sides always are as
    many; ``relational.paired`` has the choices for lists of other lengths.
    """
    rows = similarities(prompts, ref, dist)
    if corpus is not None:
        hyps = rows.select(F.coalesce(dist, F.lit("")).alias("hyp_id")).distinct().withColumn("tokens", tokens(F.col("hyp_id")))
        rows = rows.drop("cider").withColumn("_text", F.coalesce(dist, F.lit(""))).join(cider_of_corpus(hyps, corpus).withColumnRenamed("hyp_id", "_text"), "_text")
    means = rows.groupBy(key).agg(*[F.avg(n).alias(n) for n in ("bleu", "rouge_l", "cider")], F.count(F.lit(1)).alias("n_prompts"))
    score = combined(F.col("bleu"), F.col("rouge_l"), F.col("cider"), weights=weights)
    return means.select(key, *[F.bround(n, 6).alias(n) for n in ("bleu", "rouge_l", "cider")], F.bround(score, 6).alias("cognitive_score"), "n_prompts")


def idf(documents: Column, containing: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1."""
    return F.log((documents + 1) / (containing + 1)) + 1
