"""Operator 8, mixing sources to target weights by a low-discrepancy schedule.

Training slots of ``block`` words are dealt to sources by golden-ratio points mapped through the cumulative
target shares.  A source's documents, shuffled by hash, are laid end to end and cut into blocks of equal
words; its slot of rank r takes block r, going round the source again after the last block.  A source's slots end where
its target is reached, the last one being cut, and those that the points have not dealt to it follow at the end of the
schedule; so what is taken is the target rounded down, whatever the block's size.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own, last in
order; repeated rows each have a place of their own; an empty table or one without
words gives targets of 0; other columns are kept.  Reruns agree: order depends on the rows' values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, NULL_ID, scratch

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Words of a block, at every size of the corpus; a schedule has as many slots as the corpus has blocks.
BLOCK_WORDS = 1024
#: A source's documents are laid out by hash bucket, so that no window holds a source.
ROWS_PER_BUCKET = 20_000
#: Grid cells of the unit interval, and slots numbered together.
GRID, CHUNK = 4096, 512
GOLDEN = (5**0.5 - 1) / 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, rank and target: weights by rank, water-filled under ``most`` times the size.

    The sources that stop at their limit are those with the least limit for their weight, so one ordered
    pass over the table of sources finds how many do.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int"))).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    open_ = ranked.withColumn("level", level).withColumn("stops", F.col("weight") * F.col("level") >= F.col("limit"))
    # the level of the first source that does not stop holds for all after it
    final = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(all_.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return open_.withColumn("target", F.least("limit", F.coalesce(F.col("weight") * final, F.col("limit")))).select("source", "source_size", "rank", "target")


def ranked_slots(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, rank (of its source), block, epoch, upto: golden-ratio points under the cumulative target shares.

    ``upto`` is where the source's words end in that epoch: at its size, or, in its last epoch, where the target is
    reached.

    Points meet the sources' intervals by grid cell; a source's slots are numbered by chunks of the schedule,
    so neither step gathers a source in one task.
    """
    spark = sources.sparkSession
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    words, size = F.floor("target").cast("long"), F.col("source_size")
    plan = sources.where("target > 0").select("rank", "target", size.alias("size"), F.ceil(size / block).alias("blocks"), F.floor(words / size).alias("full"), (words % size).alias("rest"))
    plan = plan.withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block))
    share = plan.select("rank", (F.sum("target").over(upto) / F.sum("target").over(all_)).alias("hi"))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.desc("rank"))) == 1
    share = share.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    cells = share.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.floor(F.least("hi", F.lit(1.0)) * GRID))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("point")).withColumn("cell", F.floor(F.col("point") * GRID))
    dealt = points.join(cells, (points.cell == cells.cell) & (points.point >= cells.lo) & (points.point < cells.hi)).select("slot", "rank", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    dealt = scratch(dealt, "slots")
    base = dealt.groupBy("rank", "chunk").count().withColumn("base", F.sum("count").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    number = F.col("within") + F.coalesce("base", F.lit(0))
    ranked = dealt.withColumn("within", within).join(base, ["rank", "chunk"]).select("slot", "rank", number.alias("number"))
    # a source that the points have dealt too few slots gets the others after the schedule's end
    have = dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("have"))
    lacking = plan.join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    late = lacking.select("rank", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("number")).select((F.col("number") + slots).alias("slot"), "rank", "number")
    every = ranked.unionByName(late).join(plan.select("rank", "size", "blocks", "full", "rest", "need"), "rank").where("number < need")
    epoch = F.floor(F.col("number") / F.col("blocks"))
    return every.select("slot", "rank", (F.col("number") % F.col("blocks")).alias("block"), epoch.alias("epoch"), F.when(epoch < F.col("full"), F.col("size")).otherwise(F.col("rest")).alias("upto"))


def layout(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): every row with its place among its source's words, and the sources with targets."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("h"))
    rows = scratch(rows, "sizes")
    n = rows.count()
    sources = scratch(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    buckets = max(64, n // ROWS_PER_BUCKET)
    placed = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    same = F.col("source").eqNullSafe(F.col("_source"))
    ranks = F.broadcast(sources.withColumnRenamed("source", "_source")) if sources.count() * 128 <= BROADCAST_BYTES else sources.withColumnRenamed("source", "_source")
    placed = placed.join(ranks, same).drop("_source")
    base = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).withColumn("base", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("words")
    before = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(base, ["rank", "bucket"])
    start = F.col("before") + F.coalesce("base", F.lit(0))
    return scratch(placed.select("doc_id", "h", "rank", "size", "source_size", "target", start.alias("start")), "layout"), sources


def mixture(rows: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, epoch, rank, start, first, n: the schedule's slots with the words of documents that fill them."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    slots = ranked_slots(sources, block, -(-total // block))
    parts = rows.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    parts = parts.select("rank", "start", "block", first.alias("first"), (F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")) - first).alias("n"))
    n = F.least("n", F.col("upto") - F.col("start") - F.col("first"))
    return slots.join(parts, ["rank", "block"]).select("slot", "epoch", "rank", "start", "first", n.alias("n")).where("n > 0")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, block: int = BLOCK_WORDS) -> DataFrame:
    """Every row's doc_id, size, source_size, target and the words that the mix takes from it."""
    rows, sources = layout(docs, weights, most)
    taken = mixture(rows, sources, block).groupBy("rank", "start").agg(F.sum("n").alias("_taken")).withColumn("_some", F.lit(True))
    joined = rows.withColumn("_some", F.col("size") > 0).join(taken, ["rank", "start", "_some"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: one row for each pass over a document, with the words that the pass takes.

    A pass that takes a whole document leaves its text alone; a part is its words joined by one space, with
    n_chars, where there is such a column, counted anew.  Columns stay as they are.
    """
    rows, sources = layout(docs, weights, most)
    passes = mixture(rows, sources, block).groupBy("rank", "start", "epoch").agg(F.min("first").alias("__vg_first"), F.sum("n").alias("__vg_n"))
    places = rows.where("size > 0").join(passes, ["rank", "start"]).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__vg_doc"), F.col("h").alias("__vg_h"), F.col("size").alias("__vg_size"), "__vg_first", "__vg_n")
    whole = docs.withColumn("__vg_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__vg_h", F.xxhash64("doc_id", "source", "text"))
    joined = whole.dropDuplicates(["__vg_doc", "__vg_h"]).join(places, ["__vg_doc", "__vg_h"])
    words = F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), (F.col("__vg_first") + 1).cast("int"), F.col("__vg_n").cast("int"))
    cut = F.when(F.col("__vg_n") < F.col("__vg_size"), F.array_join(words, " ")).otherwise(F.col("text"))
    out = joined.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__vg_n") < F.col("__vg_size"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8(docs: DataFrame) -> DataFrame:
    return mix_sources(docs)
