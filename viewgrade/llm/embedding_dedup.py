"""Operator 7, embedding near-dedup by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook fitted to a bounded sample, and the product grid of
the two codebooks is the index: every vector lies in the cell of its two nearest codewords.  Codebooks grow with the
root of the number of vectors, so that a cell holds about as many at every size.  A query visits
cells in the order of its distance to them (multi-sequence traversal), as many as the target recall needs of the
true pairs that brute force finds between ``QUERIES`` vectors and all vectors, and never fewer than sample vectors
moved to the threshold in random directions need.  What shares a visited cell is verified by its cosine in doubles.
A pair that both ends visit is compared once, and a link counts for both its ends, whichever end visits the other.

Equal vectors (told by 128-bit hashes) are folded into one with its count first, so copies cost nothing and lose no link.  Cells of many
vectors are dealt in blocks; a task compares one block with its visitors as matrices and returns, besides counts,
only a spanning forest of the links that it found.

Defined results: null, zero, non-finite or wrongly long vectors (the commonest length counts) link with nothing;
a null vec_id is an id of its own; rows with equal vec_id are joined as one node, its rows counted as vectors;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, components, join_bounded, scratch

#: Vectors that codebooks and traversal are fitted to, at most: so many, and so many for each codeword.
SAMPLE, PER_CODE = 4096, 8
#: Codewords of a half, at least and at most, and the vectors of a cell, on average, that their number aims at.
CODES, MOST_CODES, PER_CELL = 16, 4096, 256
ROUNDS = 12
#: Distances (8 bytes each) between vectors of the sample and codewords that are held at a time.
DISTANCES = 1 << 20
TARGET_RECALL = 0.99
#: Vectors that are compared with all others to set the number of visits: those of the smallest hashes.
QUERIES = 512
#: Vectors of a cell that one task compares with its visitors.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords by Lloyd's algorithm from farthest-first seeds; fewer where there are fewer distinct points."""
    seeds, gap = [x[0]], ((x - x[0]) ** 2).sum(1)
    while len(seeds) < k and gap.max() > 1e-12:
        seeds.append(x[int(gap.argmax())])
        gap = np.minimum(gap, ((x - seeds[-1]) ** 2).sum(1))
    codes = np.array(seeds)
    for _ in range(rounds):
        step = max(1, DISTANCES // len(codes))
        at = np.concatenate([distances(x[i : i + step], codes).argmin(1) for i in range(0, len(x), step)])
        n = np.bincount(at, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, at, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    return codes


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1))


def codewords(vectors: int) -> int:
    """Codewords of a half for so many different vectors."""
    return min(MOST_CODES, max(CODES, math.isqrt(vectors // PER_CELL)))


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
    """Cells (rows: queries) in order of the summed distances of both halves: the nearest ``visits`` of them.

    The k nearest cells lie among codeword pairs whose ranks i, j satisfy (i + 1) (j + 1) <= k, so only that
    staircase of the sorted half distances is compared.
    """
    oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    tall = np.minimum(visits // np.arange(1, min(visits, a.shape[1]) + 1), b.shape[1])
    i = np.repeat(np.arange(len(tall)), tall)
    j = np.arange(len(i)) - np.repeat(np.cumsum(tall) - tall, tall)
    cost = np.take_along_axis(a, oa[:, i], 1) + np.take_along_axis(b, ob[:, j], 1)
    near = np.argsort(cost, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(oa[:, i], near, 1) * b.shape[1] + np.take_along_axis(ob[:, j], near, 1)


class Index:
    def __init__(self, sample: np.ndarray, cosine: float, recall: float, codes: int = CODES):
        half = sample.shape[1] // 2
        self.half = half
        self.books = kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes)
        # the least number of visits, also where there are no true pairs to measure: sample vectors moved to the threshold
        rng = np.random.default_rng(7)
        noise = rng.normal(size=sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        need = self.visits_to(cosine * sample + np.sqrt(1 - cosine**2) * noise, self.cells(sample))
        self.visits = int(np.quantile(need, recall, method="higher"))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.books
        return distances(x[:, : self.half], a).argmin(1) * len(b) + distances(x[:, self.half :], b).argmin(1)

    def visited(self, x: np.ndarray, visits: int) -> np.ndarray:
        a, b = self.books
        return multi_sequence(distances(x[:, : self.half], a), distances(x[:, self.half :], b), visits)

    def visits_to(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many visits take each row to its cell (of as near ones the last)."""
        need = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            a, b = distances(part[:, : self.half], self.books[0]), distances(part[:, self.half :], self.books[1])
            cell = cells[lo : lo + 1024]
            row = np.arange(len(part))
            reach = a[row, cell // b.shape[1]] + b[row, cell % b.shape[1]]
            b.sort(axis=1)
            # a sum that is as large but for its rounding counts as near
            need[lo : lo + 1024] = [np.searchsorted(y, r - x_, "right").sum() for y, r, x_ in zip(b, reach * (1 + 1e-12) + 1e-15, a, strict=True)]
        return np.minimum(need, len(self.books[0]) * len(self.books[1]))

    def visits_of(self, x: np.ndarray, row: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """``visits_to`` for rows of x by number; equal pairs are worked out once."""
        every = len(self.books[0]) * len(self.books[1])
        pair, back = np.unique(row * every + cells, return_inverse=True)
        return self.visits_to(x[pair // every], pair % every)[back] if len(pair) else np.empty(0, np.int64)


def visits_of_pairs(folded: DataFrame, index, cosine: float) -> dict[int, int]:
    """Number of true pairs by the visits that find them: ``QUERIES`` vectors against all, by brute force in blocks."""
    picked = folded.orderBy(F.xxhash64("unit", F.lit(2)), "rep").limit(QUERIES).collect()
    queries = folded.sparkSession.sparkContext.broadcast((np.array([r.rep for r in picked]), np.array([np.frombuffer(r.unit) for r in picked])))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, units = queries.value
        home, total = index.value.cells(units), Counter()
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                x, rep = matrix(batch.column("unit")), batch.column("rep").to_numpy()
                links = (x @ units.T >= cosine) & (rep[:, None] != reps[None, :])
                some = np.flatnonzero(links.any(axis=1))
                if len(some):
                    row, col = np.nonzero(links[some])
                    # either end may visit the other's cell
                    i = some[row]
                    need = index.value.visits_of(units, col, index.value.cells(x)[i])
                    far = need > 1
                    need[far] = np.minimum(need[far], index.value.visits_of(x, i[far], home[col[far]]))
                    total.update(need.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["visits", "pairs"])

    return {r.visits: r.pairs for r in folded.select("rep", "unit").mapInArrow(measure, "visits long, pairs long").groupBy("visits").agg(F.sum("pairs").alias("pairs")).collect()}


def visits_for(pairs: dict[int, int], recall: float) -> int:
    """The least number of visits that finds this share of the pairs; 1 without pairs."""
    found, total = 0, sum(pairs.values())
    for visits in sorted(pairs):
        found += pairs[visits]
        if found >= recall * total:
            return visits
    return 1


def matrix(column: pa.Array) -> np.ndarray:
    blob = column.cast(pa.large_binary())
    _, offs, data = blob.buffers()
    offs = np.frombuffer(offs, np.int64, len(blob) + 1, blob.offset * 8)
    return np.frombuffer(data, np.float64, count=(offs[-1] - offs[0]) // 8, offset=int(offs[0])).reshape(len(blob), -1) if len(blob) else np.empty((0, 0))


def visit_keys(column: pa.Array, cells: int) -> np.ndarray:
    """row * cells + cell for the cells (32 bits each) of every row, sorted."""
    blobs = column.to_pylist()
    row = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
    return np.sort(row * cells + np.frombuffer(b"".join(blobs), np.int32))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (id, smallest id) of each component of a bipartite block of links."""
    labels, other = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    rows, cols = np.nonzero(links)
    while True:
        low = np.full(len(left), big)
        np.minimum.at(low, rows, other[cols])
        new = np.minimum(labels, low)
        high = np.full(len(right), big)
        np.minimum.at(high, cols, new[rows])
        fresh = np.minimum(other, high)
        if (new == labels).all() and (fresh == other).all():
            break
        labels, other = new, fresh
    return list({(int(a), int(b)) for a, b in [*zip(left, labels, strict=True), *zip(right, other, strict=True)] if a != b})


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec (id, null as the smallest), usable, unit (doubles as bytes)."""
    size = F.size("embedding")
    length = vectors.where("embedding is not null").groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = length.n if length else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, n = batch.column("embedding"), len(batch)
            size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            whole = (size == dim) & (dim > 0)
            x = col.filter(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1))
            biggest = np.abs(x).max(axis=1, initial=0)
            fine = np.isfinite(x).all(axis=1) & (biggest > 0)
            x = x[fine] / biggest[fine][:, None]
            x = x / np.linalg.norm(x, axis=1)[:, None]
            rows = np.flatnonzero(whole)[fine]
            usable = np.zeros(n, bool)
            usable[rows] = True
            blobs: list = [None] * n
            for i, v in zip(rows.tolist(), x, strict=True):
                blobs[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(usable), pa.array(blobs, pa.binary())], names=["vec", "usable", "unit"])

    return vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec long, usable boolean, unit binary")


def near_classes(vectors: DataFrame, cosine: float = 0.9, recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    units = scratch(unit_vectors(vectors).withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64("unit", F.lit(3))}), "units")
    same = ["h1", "h2"]
    folded = scratch(units.where("usable").groupBy(*same).agg(F.first("unit").alias("unit"), F.min("vec").alias("rep"), F.count("*").alias("copies")), "folded")
    codes = codewords(folded.count())
    picked = folded.orderBy("h1", "rep").limit(max(SAMPLE, PER_CODE * codes)).collect()
    clear = lambda c: F.when(c != NULL_ID, c)
    if not picked:
        return units.select(clear(F.col("vec")).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), clear(F.col("vec")).alias("component_id"), F.lit(True).alias("kept"))
    index = spark.sparkContext.broadcast(Index(np.array([np.frombuffer(r.unit) for r in picked]), cosine, recall, codes))
    visits = max(index.value.visits, visits_for(visits_of_pairs(folded, index, cosine), recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                x = matrix(batch.column("unit"))
                # a vector's own cell is the nearest one, so it is always among the visited
                cells, seen = index.value.cells(x), index.value.visited(x, visits).astype(np.int32)
                seen[~(seen == cells[:, None]).any(axis=1), -1] = cells[~(seen == cells[:, None]).any(axis=1)]
                seen = pa.array([r.tobytes() for r in seen], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "h1", "copies", "unit")), pa.array(cells, pa.int64()), seen], names=["rep", "h1", "copies", "unit", "cell", "seen"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                row, cells = np.divmod(visit_keys(batch.column("seen"), every), every)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("rep", "h1", "copies", "unit", "home")), pa.array(cells, pa.int64())], names=["rep", "h1", "copies", "unit", "home", "cell"])

    every = len(index.value.books[0]) * len(index.value.books[1])
    # seen: the cells that a vector visits, 32 bits each
    placed = scratch(folded.mapInArrow(place, "rep long, h1 long, copies long, unit binary, cell long, seen binary"), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = scratch(blocks, "blocks")
    filled = blocks.count()
    members = join_bounded(placed, blocks, "cell", "inner", 16, filled).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    asking = join_bounded(placed.withColumnRenamed("cell", "home").mapInArrow(visit, "rep long, h1 long, copies long, unit binary, home long, cell long"), blocks, "cell", "inner", 16, filled)
    # a visitor meets every block of the cell, and visitors are dealt in slices
    slices = asking.groupBy("cell").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("slices"))
    slices = scratch(slices, "slices")
    asking = join_bounded(asking, slices, "cell", "inner", 16, filled).withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(1)), "slices")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = join_bounded(members, slices, "cell", "inner", 16, filled).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def compare(query: pa.Table, member: pa.Table) -> pa.Table:
        empty = {c: pa.array([], pa.int64()) for c in ("a", "b", "h1", "n")}
        if not query.num_rows or not member.num_rows:
            return pa.table(empty)
        mu, mr = matrix(member.column("unit").combine_chunks()), member.column("rep").to_numpy()
        copies, seen = member.column("copies").to_numpy(), visit_keys(member.column("seen").combine_chunks(), every)
        qu, qr = matrix(query.column("unit").combine_chunks()), query.column("rep").to_numpy()
        own, home, qh, mh = query.column("copies").to_numpy(), query.column("home").to_numpy(), query.column("h1").to_numpy(), member.column("h1").to_numpy()
        counts, edges, back = [], [], np.zeros(len(mr), np.int64)
        for lo in range(0, len(qr), 512):
            links = qu[lo : lo + 512] @ mu.T >= cosine
            some = np.flatnonzero(links.any(axis=1))
            if not len(some):
                continue
            links, at = links[some], lo + some
            links &= qr[at, None] != mr[None, :]
            # where the member visits the query's cell too, the other meeting of the two has the pair
            i, j = np.nonzero(links & (qr[at, None] > mr[None, :]))
            key = j * every + home[at[i]]
            both = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key
            links[i[both], j[both]] = False
            some = links.any(axis=1)
            if some.any():
                links, at = links[some], at[some]
                counts += zip(qr[at].tolist(), qh[at].tolist(), (links @ copies).tolist(), strict=True)
                back += own[at] @ links
                edges += forest(links, qr[at], mr)
        hit = np.flatnonzero(back)
        counts += zip(mr[hit].tolist(), mh[hit].tolist(), back[hit].tolist(), strict=True)
        # counts have no b, edges no n
        none = [None] * len(edges)
        columns = {"a": [x[0] for x in counts] + [a for a, _ in edges], "b": [None] * len(counts) + [b for _, b in edges], "h1": [x[1] for x in counts] + none, "n": [x[2] for x in counts] + none}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    keys = ["cell", "block", "slice"]
    query = asking.select("rep", "h1", "copies", "unit", "home", F.col("cell"), F.col("block").cast("int"), F.col("slice").cast("int"))
    member = members.select("rep", "h1", "copies", "unit", "seen", F.col("cell"), F.col("block").cast("int"), F.col("slice").cast("int"))
    found = scratch(query.groupBy(*keys).cogroup(member.groupBy(*keys)).applyInArrow(compare, "a long, b long, h1 long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep"), "h1").agg(F.sum("n").alias("near"))
    edges = found.where("b is not null").select("a", "b")
    # the copies of one vector are split by the adaptive join, as their side of the folded vectors has one row
    own = units.join(folded.select(*same, "rep", "copies"), same, "left").join(counts, ["rep", "h1"], "left")
    # rows that share a vec_id hold their classes together
    edges = edges.unionByName(own.where("rep <> vec").select(F.col("vec").alias("a"), F.col("rep").alias("b")))
    members_ = components(edges)
    out = own.join(members_.withColumnRenamed("node", "vec"), "vec", "left")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("near", F.lit(0)), F.lit(0)).cast("long")
    component = F.coalesce("component", "vec")
    return out.select(clear(F.col("vec")).alias("vec_id"), links.alias("n_links"), clear(component).alias("component_id"), (F.col("vec") == component).alias("kept"))


def op7(vectors: DataFrame) -> DataFrame:
    return near_classes(vectors)


#: All pairs by brute force; the vectors of the tables are all finite.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT reach.a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, reach.a = min(b) AS kept FROM reach LEFT JOIN n ON n.a = reach.a GROUP BY reach.a
"""
