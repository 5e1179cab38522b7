"""Identifier rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DISTORTIONS, PRINTABLE, SUBTASKS, TASK_GROUPS


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small fixed dictionary as a map literal; missing and null keys give the default."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A regex group, or null where the pattern is not found or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_stem(path: Column) -> Column:
    """last component without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]*$", "")


def distortion_key(key: Column) -> tuple[Column, Column]:
    """(distortion, intensity) of a file name or key; nulls where it has no level."""
    part = F.substring_index(path_stem(key), "__", -1)
    level = F.regexp_extract(part, r"_L(\d+(?:\.\d+)?)$", 1)
    value = F.nullif(level, F.lit("")).cast("double")
    name = F.regexp_replace(part, r"_L\d+(?:\.\d+)?$", "")
    return F.when(value.isNotNull(), name), F.when(value >= 1, value / 10).otherwise(value)


def reference_id(path: Column) -> Column:
    """a view path as one flat identifier."""
    flat = F.translate(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""), "/", "_")
    return F.regexp_replace(flat, r"(?<=.)\.[^.]*$", "")


def subtask_code(question_type: Column) -> Column:
    """leading code such as 1.1, else empty."""
    return F.coalesce(F.regexp_extract(F.trim(question_type), r"^(\d+\.\d+)", 1), F.lit(""))


def subtask_id(question_type: Column) -> Column:
    """0..13 by code, unknown 0."""
    return lookup({code: i for i, code in enumerate(sorted(SUBTASKS))}, subtask_code(question_type), 0)


def subtask_id_of_name(name: Column) -> Column:
    return lookup({SUBTASKS[c]: i for i, c in enumerate(sorted(SUBTASKS))}, name, 0)


def subtask_name(question_type: Column) -> Column:
    """by code, else the first name whose words occur in the text, else scene_description."""
    low = F.lower(question_type)
    by_words = [F.when(F.contains(low, F.lit(name.replace("_", " "))), F.lit(name)) for _, name in sorted(SUBTASKS.items())]
    return F.coalesce(lookup(SUBTASKS, subtask_code(question_type)), *by_words, F.lit("scene_description"))


def view_id(question_id: Column, question_type: Column) -> Column:
    """which view a question is about."""
    number = F.coalesce(group(question_id, r"_UAV(\d+)_"), group(question_id, r"_UAV(\d+)$"), group(question_type, r"\(UAV(\d+)\)"), F.lit("1"))
    return F.concat(F.lit("UAV"), number)


def two_digits(level: Column) -> Column:
    """At least two digits, never cut."""
    text = level.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def sample_id(dataset: Column, frame: Column, distortion: Column, level: Column, split: Column | None = None, question_id: Column | None = None) -> Column:
    """short or, with a split or question, full identifier."""
    frame = F.translate(frame, "/\\", "__")
    tail = F.concat(distortion, F.lit("_L"), two_digits(level))
    short = F.concat_ws("__", dataset, frame, tail)
    if split is None and question_id is None:
        return short
    split, question_id = (F.coalesce(c if c is not None else F.lit(""), F.lit("")) for c in (split, question_id))
    return F.when((split != "") | (question_id != ""), F.concat_ws("__", dataset, split, frame, question_id, tail)).otherwise(short)


def dataset_name(file_name: Column) -> Column:
    """F8."""
    stem = path_stem(file_name)
    return F.coalesce(group(stem, r"^(\w+)_VQA_"), F.substring_index(stem, "_", 1))


def md5_low32(key: Column) -> Column:
    """The low 32 bits of an md5 digest, as a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 25, 8), 16, 10).cast("long")


def distortion_seed(dataset: Column, frame: Column, distortion: Column, base: int = 42) -> Column:
    """(base + md5) mod 2**31; the high digits of the digest don't matter for it."""
    low = md5_low32(F.concat_ws("__", dataset, frame, distortion)).bitwiseAND(F.lit(2**31 - 1))
    return F.pmod(low + F.lit(base), F.lit(2**31))


def level_of(intensity: Column) -> Column:
    """truncated tenfold intensity."""
    return (intensity * 10).cast("int")


def quality_score(text: Column) -> Column:
    """'Good (4/5)' as 0.8, else 0.5."""
    return F.coalesce(group(text, r"\((\d+)/5\)").try_cast("double") / 5, F.lit(0.5))


def usability_score(text: Column) -> Column:
    """by the leading digit."""
    return lookup({"1": 1.0, "2": 0.5, "3": 0.25}, F.substring(F.trim(text), 1, 1), 0.0)


def human_score(quality: Column, usability: Column) -> Column:
    """0.4 quality + 0.6 usability, with the format's defaults for nulls."""
    return F.lit(0.4) * quality_score(F.coalesce(quality, F.lit("Fair (3/5)"))) + F.lit(0.6) * usability_score(F.coalesce(usability, F.lit("1 (Available)")))


def sample_id_parts(value: Column) -> Column:
    """F16: struct of the five parts of a full sample id; distortion and level from the last."""
    parts = F.split(value, "__")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    last = at(5)
    digits = group(last, r"_L(\d+)$")
    return F.struct(at(1).alias("dataset"), at(2).alias("split"), at(3).alias("frame"), at(4).alias("question_id"), F.regexp_replace(last, r"_L\d+$", "").alias("distortion"), (digits.cast("int") / 10).alias("intensity"))


def duration(seconds: Column) -> Column:
    """'1h 02m 03s', '2m 03s', '3s'; 0s for nothing."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).when(minutes > 0, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def prompt_text(question: Column) -> Column:
    """F18."""
    return F.concat(question, F.lit("\nAnswer concisely in 2-4 sentences."))


def chat_prompt(template: Column, prompt: Column, images: Column, placeholder: str) -> Column:
    """image placeholders go to the template's slot, or before a template that has none."""
    tags = F.repeat(F.lit(placeholder), images)
    slotted = F.contains(template, F.lit("{image_tags}"))
    body = F.replace(F.replace(template, F.lit("{image_tags}"), tags), F.lit("{prompt}"), prompt)
    return F.when(slotted, body).otherwise(F.concat(tags, body))


def model_name(name: Column, aliases: dict[str, str], registry: dict[str, str]) -> Column:
    """alias, then short name, then hub id; any other org/name stays; else null."""
    name = F.coalesce(lookup(aliases, name), name) if aliases else name
    hub = {v: k for k, v in registry.items()}
    return F.when(name.isin(list(registry)), name).when(name.isin(list(hub)), lookup(hub, name)).when(name.contains("/"), name)


def task_id(path: Column, chunk: Column) -> Column:
    """F21, on the whole relative path, so that equal names in two folders don't collide."""
    return F.concat(F.regexp_replace(path, r"(?<=.)\.[^./]*$", ""), F.lit("__"), F.when(chunk < 10000, F.lpad(chunk.cast("string"), 4, "0")).otherwise(chunk.cast("string")))


def char_ids(text: Column, most: int = 256) -> Column:
    """character codes of the first ``most`` characters; 1 for unknown ones."""
    chars = F.filter(F.split(F.substring(text, 1, most), ""), lambda c: c != "")
    return F.transform(chars, lambda c: lookup({x: i + 2 for i, x in enumerate(PRINTABLE)}, c, 1))


def task_group(name: Column) -> Column:
    """report group of a question type, null if unknown."""
    return lookup({m: g for g, members in TASK_GROUPS.items() for m in members}, name)


def distortion_category(name: Column) -> Column:
    """J9."""
    return lookup(DISTORTIONS, name, "unknown")
