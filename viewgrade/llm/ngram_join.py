"""Operator 5, n-gram Jaccard join with rare-first prefix filtering.

Documents are sets of word 5-grams; equal sets are folded into one first.  The grams of a set are put in one
global order, rare ones first, by document counts over the whole corpus.  Sets meet on the grams of their prefix; length and positional filters run
where they meet, the suffix filter and the exact test once for each pair.

Only classes are asked for, so a group that meets on one gram first tries its smallest document against the
others (a star); only pairs that verified links have not joined yet are tried further, and all of those.

Defined results: null, empty or blank texts have no grams and link with nothing; fewer words than a gram make
one gram of all words; rows with equal doc_id are one node; a null doc_id stays null but is a node of its
own (its class shows null); ties are broken by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import NULL_ID, components, join_bounded, scratch
from .repeats import distinct, keyed

#: Cells of the frequency table (a fixed size: 4 MB), and cells that travel together.
CELL_BITS = 22
CELLS = 1 << CELL_BITS
BLOCK = 1 << 16
#: Documents from which on a gram counts as common.
COMMON = 8
#: Grams that a task counts at once, and that a bucket holds.
WINDOW, BUCKET_GRAMS = 1 << 21, 1 << 21
#: Sets that are tried against one copy of a set.
FAN = 64
#: A gram with this many open pairs, at most, lists them; others try up to so many stars before.
FEW, STARS = 64, 3
#: Parts of a set's counts in the suffix filter where sets meet.
PARTS = 64


def chunk_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = K.LOWER[data]
    start, end, borders = K.words(data, offs)
    return K.word_hashes(data, start, end), borders


def gram_sets(values: np.ndarray, borders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, borders): the distinct grams of each row, sorted; fewer than k words make one gram."""
    size = np.diff(borders)
    short = np.flatnonzero((size > 0) & (size < k))
    ok = np.flatnonzero(K.in_row(borders, k, len(values)))
    row = np.concatenate([np.searchsorted(borders, ok, "right") - 1, short])
    whole = K.span_hash(K.prefix(values, K.BASE), borders[short], borders[short + 1], K.BASE)
    gram = np.concatenate([K.grams(values, k)[ok] if len(ok) else np.empty(0, np.uint64), whole])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = distinct(row, gram)
    return gram[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def frequency_table(docs: DataFrame, k: int, total: int) -> tuple[np.ndarray, int]:
    """(table, bits of its hashes over 32).  Frequency class of grams by hash cell: 0 below COMMON documents, else 4 log2 of the document count.

    Grams are counted exactly but for their last hash bits: blobs of sorted hashes with counts, one for each
    window of WINDOW grams and bucket, are added up by bucket.  Buckets grow with the corpus; the driver gets
    only this table of fixed size, which orders grams and decides nothing else.
    """
    bits = max(0, (total // BUCKET_GRAMS).bit_length())
    schema = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
    blocks = pa.schema([("block", pa.int32()), ("classes", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate(waiting), return_counts=True)
            border = np.searchsorted(ids >> K.U(32), np.arange((1 << bits) + 1).astype(np.uint64))
            some = np.flatnonzero(np.diff(border))
            low = ids.astype(np.uint32)
            return K.table({"bucket": some, "ids": [low[border[i] : border[i + 1]].tobytes() for i in some], "counts": [n[border[i] : border[i + 1]].astype(np.uint32).tobytes() for i in some]}, schema)

        waiting, size = [], 0
        for batch in batches:
            for _, _, data, offs in K.text_chunks(batch):
                gram, _ = gram_sets(*chunk_words(data, offs), k)
                waiting.append(gram >> K.U(32 - bits))
                size += len(gram)
                if size > WINDOW:
                    yield flush()
                    waiting, size = [], 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, *pair in zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True):
                held.setdefault(bucket, []).append(pair)
        found: dict[int, np.ndarray] = {}
        for bucket in sorted(held):
            pairs = held.pop(bucket)
            ids = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in pairs])
            n = np.concatenate([np.frombuffer(x, np.uint32) for _, x in pairs])
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], n[order].astype(np.int64)
            head = np.flatnonzero(distinct(ids))
            n = np.add.reduceat(n, head)
            common = n >= COMMON
            cell = cells((K.U(bucket) << K.U(32)) | ids[head][common].astype(np.uint64))
            level = np.minimum(255, 4 * np.log2(n[common])).astype(np.uint8)
            for block in np.unique(cell // BLOCK):
                into = found.setdefault(int(block), np.zeros(BLOCK, np.uint8))
                own = cell // BLOCK == block
                np.maximum.at(into, cell[own] % BLOCK, level[own])
        if found:
            yield K.table({"block": list(found), "classes": [x.tobytes() for x in found.values()]}, blocks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                found[block] = np.maximum(found.get(block, 0), np.frombuffer(blob, np.uint8))
        if found:
            yield K.table({"block": list(found), "classes": [x.tobytes() for x in found.values()]}, blocks)

    sums = keyed(docs).mapInArrow(K.released(count), "bucket long, ids binary, counts binary").repartition("bucket").mapInArrow(K.released(add), "block int, classes binary")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for block, blob in sums.repartition("block").mapInArrow(K.released(join), "block int, classes binary").collect():  # CELLS bytes at most
        out[block] = np.frombuffer(blob, np.uint8)
    return out.ravel(), bits


def cells(ids: np.ndarray) -> np.ndarray:
    return (K.mix(ids) >> K.U(64 - CELL_BITS)).astype(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc, n, d1, d2, parts: size, 128-bit digest and ``part_counts`` of every document's gram set."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("parts", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, data, offs in K.text_chunks(batch):
                gram, borders = gram_sets(*chunk_words(data, offs), k)
                n = np.diff(borders)
                pre1 = np.concatenate([[K.U(0)], np.cumsum(K.mix(gram), dtype=np.uint64)])
                pre2 = np.concatenate([[K.U(0)], np.cumsum(K.mix(gram ^ K.BASE), dtype=np.uint64)])
                yield K.table({"doc": ids[lo:hi], "n": n, "d1": (pre1[borders[1:]] - pre1[borders[:-1]]).view(np.int64), "d2": (pre2[borders[1:]] - pre2[borders[:-1]]).view(np.int64), "parts": part_counts(gram, borders)}, schema)

    return keyed(docs).mapInArrow(K.released(digest), "doc long, n int, d1 long, d2 long, parts binary")


def part_counts(gram: np.ndarray, borders: np.ndarray) -> list[bytes | None]:
    """A byte for each part of the hash space: how many of a row's grams fall there; None where a byte is too small."""
    rows = len(borders) - 1
    count = np.bincount(K.row_of(borders) * PARTS + (K.mix(gram) >> K.U(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=rows * PARTS).reshape(rows, PARTS)
    return [x.tobytes() if fits else None for x, fits in zip(count.astype(np.uint8), (count < 256).all(axis=1), strict=True)]


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def postings(docs: DataFrame, frequency, k: int, percent: int) -> DataFrame:
    """gram, doc, n, pos, before for the prefix of each set, where at least two documents share the gram."""
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, _, data, offs in K.text_chunks(batch):
                gram, borders = gram_sets(*chunk_words(data, offs), k)
                table, bits = frequency.value
                row, n = K.row_of(borders), np.diff(borders)
                token = (table[cells(gram >> K.U(32 - bits))].astype(np.uint64) << K.U(56)) | (gram >> K.U(8))
                order = np.lexsort((token, row))  # rows stay where they are
                pos = np.arange(len(order)) - borders[row]
                keep = pos < prefix_size(n, percent)[row]
                row = row[keep]
                yield K.table({"gram": token[order][keep].view(np.int64), "doc": ids[lo + row], "n": n[row], "pos": pos[keep]}, schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in schema.names] for b in batches]
        if not parts:
            return
        gram, doc, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, gram))
        gram, doc, n, pos = gram[order], doc[order], n[order], pos[order]
        head, place = distinct(gram), distinct(gram, doc)
        group = np.cumsum(head) - 1
        keep = np.bincount(group, place)[group] > 1
        yield K.table({"gram": gram[keep], "doc": doc[keep], "n": n[keep], "pos": pos[keep]}, schema)

    rows = docs.mapInArrow(K.released(prefixes), "gram long, doc long, n int, pos int")
    kept = rows.repartition("gram").mapInArrow(K.released(shared), "gram long, doc long, n int, pos int")
    # a set's prefix grams that no other set has are in no intersection: before counts the others
    before = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    return scratch(kept.withColumn("before", before), "postings")


def possible(n1, p1, b1, n2, p2, b2, percent: int):
    """Length and positional filters for two sets that share the gram at places p1, p2 of their orders.

    What they share before it is among the b1, b2 grams there that other sets have too.
    """
    lengths = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    most = np.minimum(b1, b2) + np.minimum(n1 - p1, n2 - p2)
    return lengths & (most >= overlap_needed(n1, n2, percent))


def parts_reach(parts: np.ndarray, known: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: two sets share no more of a part of the hash space than either has there."""
    ok = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        most = np.minimum(parts[x], parts[y]).sum(axis=1, dtype=np.int64)
        ok[lo : lo + (1 << 16)] = (most >= overlap_needed(n[x], n[y], percent)) | ~(known[x] & known[y])
    return ok


def candidates(post: DataFrame, percent: int, star: int | None) -> DataFrame:
    """a < b: pairs that meet on a gram in different classes, and a = b where a gram has open pairs left.

    A gram with few open pairs lists them all; one with more tries one chosen document against the others,
    unless ``star`` is None.  Then ``post`` has ``parts``, too, and pairs must pass the suffix filter to be listed.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        gram, doc, n, pos, before, kind = (np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("gram", "doc", "n", "pos", "before", "class"))
        if star is None:
            found = [b.column("parts") for b in held]
            known = np.concatenate([x.is_valid().to_numpy(zero_copy_only=False) for x in found])
            parts = np.frombuffer(b"".join(v or bytes(PARTS) for x in found for v in x.to_pylist()), np.uint8).reshape(-1, PARTS)
            held.clear()
        order = np.lexsort((kind, gram))
        new = distinct(gram[order], kind[order])
        per = np.diff(np.append(np.flatnonzero(new), len(gram)))
        which = np.cumsum(distinct(gram[order]))[new] - 1
        total = np.bincount(which, per)
        open_ = (total**2 - np.bincount(which, per.astype(float) ** 2)) / 2
        # the document with the fewest rarer grams before this one has the least of its own: the likeliest centre
        order = np.lexsort((doc, pos, gram) if star == 0 else (n, gram) if star == 2 else (doc, gram))
        gram, doc, n, pos, before, kind = (x[order] for x in (gram, doc, n, pos, before, kind))
        if star is None:
            parts, known = parts[order], known[order]
        head = np.flatnonzero(distinct(gram))
        size = np.diff(np.append(head, len(gram)))
        group = np.repeat(np.arange(len(head)), size)
        all_ = (open_ <= FEW) | (star is None)

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            chosen = np.repeat(head + (size // 2 if star == 2 else 0), size)
            some = np.flatnonzero(~all_[group])
            yield chosen[some], some
            at = np.flatnonzero(all_[group] & (open_[group] > 0))
            last = (head + size)[group]
            step = 1
            while len(at):
                at = at[at + step < last[at]]
                yield at, at + step
                step += 1

        found, waiting = [np.column_stack([doc[:1], doc[:1]])] if not all_.all() else [], 0
        for i, j in steps():
            ok = (kind[i] != kind[j]) & (doc[i] != doc[j])
            i, j = i[ok], j[ok]
            ok = possible(n[i], pos[i], before[i], n[j], pos[j], before[j], percent)
            i, j = i[ok], j[ok]
            if star is None:
                ok = parts_reach(parts, known, n, i, j, percent)
                i, j = i[ok], j[ok]
            if len(i):
                found.append(np.sort(np.column_stack([doc[i], doc[j]]), axis=1))
                waiting += len(found[-1])
            if waiting > 1 << 20:
                rows, found, waiting = np.unique(np.concatenate(found), axis=0), [], 0
                yield K.table({"a": rows[:, 0], "b": rows[:, 1]}, schema)
        if found:
            rows = np.unique(np.concatenate(found), axis=0)
            yield K.table({"a": rows[:, 0], "b": rows[:, 1]}, schema)

    return post.repartition("gram").mapInArrow(K.released(meet), "a long, b long").distinct()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets, behind the length filter and a suffix filter of depth 3; empty sets link with nothing."""
    if not len(x) or not len(y):
        return False
    need = int(overlap_needed(len(x), len(y), percent))
    if min(len(x), len(y)) < need:
        return False
    at = np.linspace(0, len(y), 9).astype(np.int64)
    cuts = np.concatenate([[0], np.searchsorted(x, y[at[1:-1]]), [len(x)]])
    if np.abs(np.diff(cuts) - np.diff(at)).sum() > len(x) + len(y) - 2 * need:
        return False
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[place] == y).sum()) >= need


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold.  Sets meet at their pair's smaller document, FAN at a time."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts"))
    others = pairs.join(fan, "a").select(F.col("b").alias("doc"), F.struct(F.col("a").alias("a"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")).alias("to"))
    centres = fan.select(F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("doc", F.struct(F.col("doc").alias("a"), "salt").alias("to"))
    need = scratch(others.unionByName(centres).groupBy("doc").agg(F.collect_list("to").alias("to")), "sets")
    rows, size = need.agg(F.count("*"), F.coalesce(F.sum(F.size("to")), F.lit(0))).first()
    schema = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("grams", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, to = batch.column("doc").to_numpy(), batch.column("to")
            for lo, hi, data, offs in K.text_chunks(batch):
                gram, borders = gram_sets(*chunk_words(data, offs), k)
                part = to.slice(lo, hi - lo)
                flat, row = part.flatten(), np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                blobs = [gram[x:y].tobytes() for x, y in zip(borders[:-1], borders[1:], strict=True)]
                yield K.table({"a": flat.field("a").to_numpy(), "salt": flat.field("salt").to_numpy(), "doc": ids[lo + row], "grams": [blobs[i] for i in row]}, schema)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for batch in batches:
            links = []
            for a, salt, doc, blob in zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True):
                if (a, salt) != at:
                    at, centre = (a, salt), []
                x = np.frombuffer(blob, np.uint64)
                if doc == a:
                    centre.append(x)
                elif any(alike(c, x, percent) for c in centre):
                    links.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    sent = join_bounded(keyed(docs), need, "doc", "inner", 24 + 48 * size // max(rows, 1), rows).mapInArrow(K.released(send), "a long, salt int, doc long, grams binary")
    placed = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("doc") != F.col("a"))
    return scratch(placed.mapInArrow(K.released(test), "a long, b long"), "links")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: classes of documents linked at the threshold."""
    spark = docs.sparkSession
    sets = scratch(sketches(docs, k), "sketches")
    classes = scratch(sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep")), "classes")
    folded = sets.join(classes, ["d1", "d2", "n"]).groupBy("doc").agg(F.bool_and(F.col("doc") != F.col("rep")).alias("copy")).where("copy").select("doc")
    folded = scratch(folded, "folded")
    single = join_bounded(keyed(docs), folded, "doc", "left_anti", 16)
    grams = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequency = spark.sparkContext.broadcast(frequency_table(docs, k, grams))
    post = postings(single, frequency, k, percent)
    total = post.count()
    links = spark.createDataFrame([], "a long, b long")
    tried, members, star = None, None, 0
    while total:
        if members is None:
            now = post.withColumn("class", F.col("doc"))
        else:
            now = post.join(members.withColumnRenamed("node", "doc"), "doc", "left").select("gram", "doc", "n", "pos", "before", F.coalesce("component", "doc").alias("class"))
        if star >= STARS:  # a doc_id that several rows share has no counts of its own
            counts = sets.where("n > 0").groupBy("doc").agg(F.when(F.count("*") == 1, F.first("parts")).alias("parts"))
            now = now.join(counts, "doc")
        found = scratch(candidates(now, percent, star if star < STARS else None), "pairs")
        pairs = found.where("a < b") if tried is None else found.where("a < b").join(tried, ["a", "b"], "left_anti")
        if not pairs.isEmpty():
            tried = pairs if tried is None else tried.unionByName(pairs)
            links = links.unionByName(verified(docs, pairs, k, percent))
            members = scratch(components(links), "members")
        star += 1
        if found.where("a = b").isEmpty():
            break
    own = sets.join(classes, ["d1", "d2", "n"], "left")
    # rows that share a doc_id hold their classes together
    bridges = own.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).join(sets.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("a")), "a", "left_semi")
    if not bridges.isEmpty():
        members = scratch(components(links.unionByName(bridges)), "members")
    if members is not None:
        own = own.join(members.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        own = own.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep", "doc")
    clear = lambda c: F.when(c != NULL_ID, c)
    return own.select(clear(F.col("doc")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), clear(component).alias("component_id"))


def op5(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs)


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each class kept: the smallest doc_id; rows with that doc_id are all kept."""
    kept = jaccard_classes(docs, k, percent).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__vg_doc")).distinct()
    kept = scratch(kept, "kept")
    return join_bounded(docs.withColumn("__vg_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))), kept, "__vg_doc", "left_semi", 16).drop("__vg_doc")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
