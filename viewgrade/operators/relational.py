"""Projections, joins, aggregates, set operations and limits of the dataset flow (P*, J*, A*, O*, L*, W2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import DISTORTIONS, REPORT_CATEGORY, SUBTASKS, UAV_DISTORTIONS
from ..functions import stats, strings


# -- projections and filters ------------------------------------------------------------------------------

def benchmark_samples(samples: DataFrame) -> DataFrame:
    """Rows with views; the first view by key gives path and reference."""
    keys = F.array_sort(F.map_keys("uav_paths"))
    first = F.try_element_at(keys, F.lit(1))
    info = F.col("distortion_info")
    ref = F.try_element_at("uav_paths", first)
    return samples.where(F.size("uav_paths") > 0).select(
        F.coalesce(F.try_element_at("distorted_uav_paths", first), F.lit("")).alias("path"), ref.alias("ref_path"), "uav_paths", keys.alias("uav_keys"), "distorted_uav_paths",
        F.coalesce("subtask_type", F.lit("unknown")).alias("task"), F.coalesce(info["type"], F.lit("unknown")).alias("distortion"), F.coalesce(info["category"], F.lit("unknown")).alias("category"),
        F.coalesce(info["intensity"], F.lit(0.5)).alias("intensity_level"), F.coalesce("cognitive_score", F.lit(0.0)).alias("score"), strings.path_stem(ref).alias("ref_id"), "sample_id")


def training_rows(samples: DataFrame) -> DataFrame:
    """Scores default to 0, unknown subtasks to id 0, distortions to unknown at 0."""
    return samples.withColumn("score", F.coalesce("cognitive_score", F.lit(0.0))).withColumn("task_id", strings.subtask_id_of_name(F.col("subtask_type"))).withColumn("distortion", F.coalesce(F.col("distortion_info.type"), F.lit("unknown"))).withColumn("intensity", F.coalesce(F.col("distortion_info.intensity"), F.lit(0.0)))


def subtask_filter(column: Column, names: str) -> Column:
    """Membership in a comma list."""
    return column.isin([x.strip() for x in names.split(",") if x.strip()])


def distortion_filter(column: Column, kind: str) -> Column:
    """P4: 'uav_only', 'generic' (all others, unknown ones too), or anything else for no filter."""
    return {"uav_only": column.isin(UAV_DISTORTIONS), "generic": ~column.isin(UAV_DISTORTIONS)}.get(kind, F.lit(True))


def single_view_question(options: Column, view: Column, paths: Column) -> Column:
    """No option names another view, and the view has a path."""
    other = F.exists(F.map_values(options), lambda v: v.contains("UAV") & ~v.contains(view))
    return ~other & F.map_contains_key(paths, view)


def empty_record(*columns: str) -> Column:
    """All blank or null."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.coalesce(F.col(c), F.lit("")) == "")
    return test


def contained_path(path: Column) -> Column:
    """A relative path cleaned of leading slashes, null if it climbs out of its root."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    steps = F.filter(F.split(clean, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return F.when(depth["low"] >= 0, clean)


# -- joins ------------------------------------------------------------------------------------------------

def consolidate(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (sample_id, model, score, ord; the last wins) as a new map and mean; others stay as they are."""
    last = scores.groupBy("sample_id", "model").agg(F.max_by("score", "ord").alias("score"))
    maps = last.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("_scores"))
    joined = samples.join(maps, "sample_id", "left")
    mean = F.aggregate(F.map_values("_scores"), F.lit(0.0), lambda s, v: s + v) / F.size("_scores")
    found = F.col("_scores").isNotNull()
    return joined.withColumn("vlm_scores", F.when(found, F.col("_scores")).otherwise(F.col("vlm_scores"))).withColumn("cognitive_score", F.when(found, F.bround(mean, 6)).otherwise(F.col("cognitive_score"))).drop("_scores")


def orphan_scores(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored ids that no sample has."""
    return scores.select("sample_id").distinct().join(samples, "sample_id", "left_anti")


def first_suffix_match(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """For each image stem the prompts of the first indexed stem it ends with.

    Reversed, a stem is a prefix of the images it fits, so it stands before them in sorted order with nothing in between that
    does not begin with it.  Stems and images are dealt into ranges of that order and swept once: the stems that the string
    at hand begins with are a stack.  A stem's images may lie in later ranges, too; those begin with the stack that the ranges
    before leave, which is found from each range's first string and the stems alone: they are the stems that are prefixes of it.
    """
    stems = prompts.where(F.col("stem").isNotNull()).groupBy(F.reverse("stem").alias("text")).agg(F.min(F.struct("ord", "prompt")).alias("p"))
    kind = stems.schema["p"].dataType
    both = stems.select("text", F.lit(0).alias("image"), "p").unionByName(images.select(F.reverse("image").alias("text"), F.lit(1).alias("image"), F.lit(None).cast(kind).alias("p")).where("text IS NOT NULL"))
    order = ["text", "image"]
    rows = stats.dealt(both, *order)
    firsts = rows.groupBy("_part").agg(F.min("text").alias("first"))  # a row for each range
    # the prefixes of a range's first string that are stems of ranges before it
    cuts = firsts.select("_part", F.explode(F.transform(F.sequence(F.lit(0), F.length("first")), lambda n: F.substring(F.col("first"), F.lit(1), n))).alias("text"))
    open_ = cuts.join(rows.where("image = 0").select("text", "p", F.col("_part").alias("_from")), "text").where("_from < _part").select("text", F.lit(-1).alias("image"), "p", "_part")
    swept = rows.unionByName(open_).repartition("_part").sortWithinPartitions("_part", "text", "image")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row by row: the stack holds the stems that the string at hand begins with, and the least of them so far."""
        part, stack = None, []
        for batch in batches:
            names, found = [], []
            for text, image, p, own in zip(*(batch.column(c).to_pylist() for c in ("text", "image", "key", "_part")), strict=True):
                if own != part:
                    part, stack = own, []
                while stack and not text.startswith(stack[-1][0]):
                    stack.pop()
                if image < 1:
                    stack.append((text, p if not stack else min(stack[-1][1], p)))
                elif stack:
                    names.append(text)
                    found.append(stack[-1][1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], names=["text", "key"])

    # places are carried through the sweep, prompts meet them after it
    keyed = swept.select("text", "image", F.col("p.ord").cast("long").alias("key"), "_part")
    hits = keyed.mapInArrow(sweep, "text string, key long")
    prompt = prompts.where(F.col("stem").isNotNull()).groupBy(F.col("ord").cast("long").alias("key")).agg(F.min_by("prompt", "stem").alias("prompt"))
    return hits.join(prompt, "key").groupBy(F.reverse("text").alias("image")).agg(F.min_by("prompt", "key").alias("prompt"))


def expand(entries: DataFrame, distortions: DataFrame, key: list[str]) -> DataFrame:
    """Each entry of a group with each distortion that its group kept."""
    return entries.join(distortions, key)


def all_distortions(groups: DataFrame) -> DataFrame:
    """Every group with the whole catalogue, by exploding a literal of its 36 names."""
    names = F.array(*[F.struct(F.lit(n).alias("distortion"), F.lit(c).alias("category")) for n, c in DISTORTIONS.items()])
    return groups.select("*", F.inline(names))


def zip_views(ref: Column, dist: Column) -> Column:
    """Views in key order with both paths; a missing distorted one is empty."""
    return F.transform(F.array_sort(F.map_keys(ref)), lambda k: F.struct(k.alias("view"), F.try_element_at(ref, k).alias("ref"), F.coalesce(F.try_element_at(dist, k), F.lit("")).alias("dist")))


def paired(a: Column, b: Column, other: str = "truncate") -> Column:
    """Two lists zipped.  ``other`` lengths: 'truncate' to the shorter one, 'raise', or 'null' (the row has no pairs)."""
    if other == "truncate":
        return truncated_pairs(a, b)
    fault = F.raise_error(F.format_string("lists of %d and %d", F.size(a), F.size(b))) if other == "raise" else F.lit(None)
    if other not in ("raise", "null"):
        raise ValueError(other)
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(fault)


def truncated_pairs(a: Column, b: Column) -> Column:
    """Two lists zipped to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def compare_outputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Places (source_file, ord) that are missing, extra or hold another sample.

    Ids are compared only where both sides have one.
    """
    old = before.select("source_file", "ord", F.col("sample_id").alias("old"), F.lit(True).alias("_in"))
    new = after.select("source_file", "ord", F.col("sample_id").alias("new"), F.lit(True).alias("_out"))
    joined = old.join(new, ["source_file", "ord"], "full_outer")
    fault = F.when(F.col("_out").isNull(), "missing").when(F.col("_in").isNull(), "extra").when(F.col("old") != F.col("new"), "order")
    return joined.withColumn("fault", fault).where("fault is not null").drop("_in", "_out")


def file_faults(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_file, fault, at: a line for each file that is missing, extra, of another length, or out of order.

    ``at`` is the first place where a file of the same length holds another sample.
    """
    size = lambda rows, name: rows.groupBy("source_file").agg(F.count(F.lit(1)).alias(name))
    sizes = size(before, "n_in").join(size(after, "n_out"), "source_file", "full_outer")
    first = compare_outputs(before, after).where("fault = 'order'").groupBy("source_file").agg(F.min("ord").alias("at"))
    n_in, n_out = F.col("n_in"), F.col("n_out")
    fault = F.when(n_out.isNull(), "missing").when(n_in.isNull(), "extra").when(n_in != n_out, "count").when(F.col("at").isNotNull(), "order")
    out = sizes.join(first, "source_file", "left").withColumn("fault", fault).where("fault IS NOT NULL")
    return out.select("source_file", "fault", F.when(F.col("fault") == "order", F.col("at")).alias("at"))


def output_verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: valid, errors (their number), file_count and total_records of the outputs (records of known files)."""
    errors = file_faults(before, after).agg(F.count(F.lit(1)).alias("errors"))
    known = before.select("source_file").distinct().withColumn("_known", F.lit(True))
    sizes = after.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).join(known, "source_file", "left")
    found = sizes.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("total_records"))
    return errors.crossJoin(found).select((F.col("errors") == 0).alias("valid"), "errors", "file_count", "total_records")  # of one row each


def affected_chunks(bad: DataFrame, chunk: int) -> DataFrame:
    """The chunks that hold any of the rows (source_file, ord)."""
    return bad.select("source_file", F.floor(F.col("ord") / chunk).cast("int").alias("chunk_id")).distinct()


# -- aggregates -------------------------------------------------------------------------------------------

def scene_groups(entries: DataFrame) -> DataFrame:
    """A1: frames with their entry count and the views of their first entry; rows without a frame go."""
    return entries.where(F.coalesce("sequence_frame", F.lit("")) != "").groupBy("sequence_frame").agg(F.count(F.lit(1)).alias("n"), F.min_by("uav_paths", "ord").alias("uav_paths"))


def prompt_index(entries: DataFrame) -> DataFrame:
    """Prompts of each stem in order."""
    return entries.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "prompt"))), lambda x: x["prompt"]).alias("prompts"))


def last_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def _zero_few(column: str, n: str = "n") -> Column:
    return F.when(F.coalesce(F.col(n), F.lit(0)) < stats.LEAST, F.lit(0.0)).otherwise(F.col(column))


def by_task(preds: DataFrame) -> DataFrame:
    """All 14 subtasks, with zeros below three rows; unknown names count as the first."""
    known = preds.withColumn("task_id", strings.subtask_id_of_name(F.col("task")))
    found = stats.quality_metrics(known, ["task_id"])
    names = F.array(*[F.lit(SUBTASKS[c]) for c in sorted(SUBTASKS)])
    dim = preds.sparkSession.range(1).select(F.posexplode(names).alias("task_id", "task"))
    joined = dim.join(found, "task_id", "left")
    return joined.select("task", *[_zero_few(c).alias(c) for c in ("srcc", "plcc", "rmse")], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_distortion(preds: DataFrame) -> DataFrame:
    """The distortions present, with Kendall's tau (null below three rows, which have no such figure)."""
    found = stats.all_metrics(preds, ["distortion"])
    kendall = F.when(F.col("n") >= stats.LEAST, F.col("kendall_tau"))
    return found.select("distortion", *[_zero_few(c).alias(c) for c in ("srcc", "plcc", "rmse")], kendall.alias("kendall_tau"), "n")


def by_uav_or_generic(preds: DataFrame) -> DataFrame:
    """A10: two rows, UAV and Generic."""
    kind = F.when(F.col("distortion").isin(UAV_DISTORTIONS), "UAV").otherwise("Generic")
    found = stats.quality_metrics(preds.withColumn("kind", kind), ["kind"])
    dim = preds.sparkSession.range(1).select(F.explode(F.array(F.lit("UAV"), F.lit("Generic"))).alias("kind"))
    return dim.join(found, "kind", "left").select("kind", *[_zero_few(c).alias(c) for c in ("srcc", "plcc", "rmse")], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def macro_srcc(preds: DataFrame) -> DataFrame:
    """Unweighted mean of the distortions' rank correlations, for UAV and generic ones."""
    kind = F.when(F.col("distortion").isin(UAV_DISTORTIONS), "UAV").otherwise("Generic")
    found = stats.quality_metrics(preds, ["distortion"]).withColumn("srcc", _zero_few("srcc"))
    return found.groupBy(kind.alias("kind")).agg(F.avg("srcc").alias("macro_srcc"))


def method_report(scored: DataFrame) -> DataFrame:
    """All figures of each method, overall and by subtask and by kind of distortion, in one stacked frame.

    ``scored``: method, task, distortion, pred, target.  Columns: method, slice (all, task or kind), name and A7.
    Slices below three rows have zeros; a subtask without rows has no line.
    """
    kind = F.when(F.col("distortion").isin(UAV_DISTORTIONS), "UAV").otherwise("Generic")
    known = [SUBTASKS[c] for c in sorted(SUBTASKS)]
    task = F.when(F.col("task").isin(known), F.col("task")).otherwise(F.lit(known[0]))
    slices = F.array(*[F.struct(F.lit(s).alias("slice"), name.alias("name")) for s, name in (("all", F.lit("all")), ("task", task), ("kind", kind))])
    rows = scored.select("method", "pred", "target", F.inline(slices))
    found = stats.all_metrics(rows, ["method", "slice", "name"])
    return found.select("method", "slice", "name", *[_zero_few(c).alias(c) for c in ("srcc", "plcc", "rmse", "kendall_tau")], "n")


def table_one(samples: DataFrame) -> DataFrame:
    """Rows and frames of each dataset and a total row; total frames are the sum of the datasets'."""
    per = samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("sequence_frame").alias("refs"), F.count_if(F.col("distortion").isin(UAV_DISTORTIONS)).alias("uav_pairs"))
    return per.rollup("dataset").agg(F.sum("pairs").alias("pairs"), F.sum("refs").alias("refs"), F.sum("uav_pairs").alias("uav_pairs")).withColumn("dataset", F.coalesce("dataset", F.lit("Total")))


def means_by_level(samples: DataFrame) -> DataFrame:
    """Means of (distortion, level), of distortion, and the grand mean, in one pass."""
    sets = [["distortion", "level"], ["distortion"], []]
    return samples.groupingSets([[F.col(c) for c in x] for x in sets], F.col("distortion"), F.col("level")).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def error_by_level(samples: DataFrame) -> DataFrame:
    """Mean and standard error (population deviation over root n) by level."""
    return samples.groupBy("level").agg(F.avg("score").alias("mean"), (F.stddev_pop("score") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def level_correlation(stacked: DataFrame) -> DataFrame:
    """Rank correlation of level and score for each distortion and model, then the mean by model."""
    per = stats.spearman(stacked, ["distortion", "model"], "level", "score")
    return per.groupBy("model").agg(F.avg("srcc").alias("mean_srcc"), F.count(F.lit(1)).alias("n"))


def pivot_means(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Mean score, a row for each subtask and a column for each named distortion."""
    return samples.groupBy("subtask_type").pivot("distortion", columns).agg(F.avg("score"))


def model_agreement(stacked: DataFrame) -> DataFrame:
    """Rank correlation of every two models over the samples both scored."""
    a = stacked.select("sample_id", F.col("model").alias("model_a"), F.col("score").alias("_a"))
    b = stacked.select("sample_id", F.col("model").alias("model_b"), F.col("score").alias("_b"))
    pairs = a.join(b, "sample_id").where("model_a < model_b")
    return stats.spearman(pairs, ["model_a", "model_b"], "_a", "_b")


def mean_agreement(stacked: DataFrame) -> DataFrame:
    """Mean of the matrix of rank correlations off its diagonal (each pair of models stands there twice)."""
    return model_agreement(stacked).agg(F.avg("srcc").alias("mean_srcc"), (2 * F.count(F.lit(1))).alias("n"))


def report_categories(samples: DataFrame) -> DataFrame:
    """Mean and population deviation by report category; unknown ones are Other."""
    return samples.groupBy(strings.lookup(REPORT_CATEGORY, F.col("category"), "Other").alias("report_category")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n"))


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by file and status, all in one pass."""
    per = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "success", "failed")}
    return tasks.groupBy("file_path").agg(*per.values(), F.count(F.lit(1)).alias("total"))


def with_status(tasks: DataFrame, *states: str) -> DataFrame:
    """P10: tasks in any of the states, in order of file and chunk."""
    return tasks.where(F.col("status").isin(*states)).orderBy("file_path", "chunk_id")


def pending_tasks(tasks: DataFrame, after_crash: bool = False) -> DataFrame:
    """P10: what is to be done: pending and failed tasks, after a crash also those left running."""
    return with_status(tasks, "pending", "failed", *(["running"] if after_crash else []))


def status_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """The last status of each task (changes: task_id, status, at); a failure counts as one more retry."""
    last = changes.groupBy("task_id").agg(F.max_by("status", "at").alias("_status"), F.count_if(F.col("status") == "failed").alias("_fails"))
    joined = tasks.join(last, "task_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("retry_count", (F.col("retry_count") + F.coalesce("_fails", F.lit(0))).cast("int")).drop("_status", "_fails")


def splits_of_stage(stage: str | None) -> dict[str, str]:
    """Which split feeds which role: the test split validates and tests, None sets up all roles."""
    roles = {"fit": {"train": "train", "validate": "test", "test": "test"}, "validate": {"train": "train", "validate": "test"}, "test": {"test": "test"}}
    return roles["fit"] if stage is None else roles.get(stage, {})


def split_rows(samples: DataFrame, stage: str | None = None) -> DataFrame:
    """Samples with the role they play in a stage; a row of the test split plays several."""
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(split).alias("_split")) for role, split in splits_of_stage(stage).items()])
    return samples.select("*", F.explode(F.filter(roles, lambda r: r["_split"] == F.col("split"))["role"]).alias("role"))


# -- sets and limits --------------------------------------------------------------------------------------

def split_lookup(images: DataFrame) -> DataFrame:
    """O1: image -> split; what is in both is test, and counted as overlap.  One shuffle."""
    seen = images.groupBy("image").agg(F.bool_or(F.col("split") == "test").alias("_test"), F.bool_or(F.col("split") == "train").alias("_train"))
    return seen.select("image", F.when(F.col("_test"), "test").otherwise("train").alias("split"), (F.col("_test") & F.col("_train")).alias("overlap"))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """L2, L4: the first n rows in an order (a distributed top-n, not a global window)."""
    return rows.orderBy(*order).limit(n)


#: Rows of a file whose running count is worked out together.
CAP_CHUNK = 1 << 16


def scored_within_cap(rows: DataFrame, cap: int | None, file: str = "source_file", order: str = "ord") -> DataFrame:
    """L3: rows with views up to the cap of each file; scored rows count too, no cap means all.

    A file is counted by chunks of its order, so that no task holds a file.
    """
    usable = F.size("uav_paths") > 0
    if not cap:
        return rows.where(usable)
    dealt = rows.where(usable).withColumn("_chunk", F.floor(F.col(order) / CAP_CHUNK))
    chunks = dealt.groupBy(file, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # chunks that begin after the cap are out as a whole
    some = chunks.withColumn("_before", before).where(F.col("_before") < cap).drop("_n")
    counted = F.col("_before") + F.row_number().over(Window.partitionBy(file, "_chunk").orderBy(order))
    return stats.joined(dealt, some, [file, "_chunk"]).withColumn("_k", counted).where(F.col("_k") <= cap).drop("_k", "_chunk", "_before")


def list_mle(preds: DataFrame, tie: str = "id") -> DataFrame:
    """ListMLE loss of each distortion with three rows or more, by a reverse running log-sum-exp.

    Rows are dealt into ranges of the list's order, falling target and then the tie breaker; a row's tail is its range's
    running sum and the sums of the ranges after it.  The sum runs from the list's end, as Spark adds a frame that begins
    at the row and ends with the partition anew for each row.
    """
    by, order, from_end = ["distortion"], [F.desc("target"), F.col(tie)], [F.asc("target"), F.desc(tie)]
    peaks = preds.groupBy(*by).agg(F.max("pred").alias("_peak"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= stats.LEAST)
    rows = stats.joined(preds, peaks, by).withColumn("_e", F.exp(F.col("pred") - F.col("_peak")))
    rows = stats.dealt(rows.select(*by, "pred", "target", tie, "_peak", "_e"), *by, *order)
    sums = stats.before(rows.groupBy(*by, "_part").agg(F.sum("_e").alias("_s")), by, "_s", F.desc("_part")).select(*by, "_part", "_before")
    placed = stats.joined(rows, sums, [*by, "_part"])
    tail = F.col("_before") + F.sum("_e").over(Window.partitionBy(*by, "_part").orderBy(*from_end).rowsBetween(Window.unboundedPreceding, 0))
    term = placed.withColumn("_t", F.log(tail) + F.col("_peak") - F.col("pred"))
    return term.groupBy("distortion").agg((F.sum("_t") / F.count(F.lit(1))).alias("loss"))


def total_loss(preds: DataFrame, task_scores: DataFrame, rank_weight: float = 0.3, task_weight: float = 0.1) -> DataFrame:
    """U16: squared error, ListMLE and cross-task terms of each list, and their weighted sum."""
    error = preds.groupBy("distortion").agg(F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))).alias("mse"))
    terms = stats.joined(error, list_mle(preds).withColumnRenamed("loss", "list_mle"), ["distortion"], "left")
    terms = terms.crossJoin(F.broadcast(cross_task_loss(task_scores).select(F.coalesce("loss", F.lit(0.0)).alias("_cross"))))  # one row
    cross = F.col("_cross")
    return terms.select("distortion", "mse", "list_mle", cross.alias("cross_task"), (F.col("mse") + rank_weight * F.coalesce("list_mle", F.lit(0.0)) + task_weight * cross).alias("loss"))


def cross_task_loss(preds: DataFrame) -> DataFrame:
    """U16: minus the mean over task pairs of the mean squared difference of their predictions; 0 below two tasks.

    By sums: the pairs' differences add up from each sample's sum and sum of squares.
    """
    per = preds.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("pred").alias("s"), F.sum(F.col("pred") * F.col("pred")).alias("q"))
    value = F.when(F.col("k") < 2, F.lit(0.0)).otherwise((F.col("k") * F.col("q") - F.col("s") * F.col("s")) / (F.col("k") * (F.col("k") - 1) / 2))
    return per.agg((-F.avg(value)).alias("loss"))
