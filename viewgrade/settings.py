"""Typed settings of a scoring run (S22): from a mapping, a JSON or YAML file, or the session's own configuration."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the settings in a session's configuration.
PREFIX = "spark.viewgrade."


@dataclass(frozen=True)
class RunSettings:
    """What a run reads, where it writes, and how its scorer is fed.  ``max_entries`` 0 is no limit, ``num_gpus`` 0 no GPU."""

    input_dir: str
    output_dir: str
    progress_dir: str
    chunk_size: int = 256
    batch_size: int = 16
    num_gpus: int = 1
    model_name: str = "constant"
    seed: int = 42
    glob_pattern: str = "*_VQA_*.json"
    max_entries: int = 0
    raw_data_dir: str | None = None
    distorted_data_dir: str | None = None
    scorer_options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("input_dir", "output_dir", "progress_dir", "glob_pattern", "model_name"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} is blank")
        for name, least in (("chunk_size", 1), ("batch_size", 1), ("num_gpus", 0), ("max_entries", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} is below {least}")

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> RunSettings:
        """Settings by name; texts become numbers where numbers belong.  An unknown name or a missing folder is an error."""
        hints = get_type_hints(cls)
        unknown = sorted(set(given) - set(hints))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        missing = [f.name for f in dataclasses.fields(cls) if f.default is f.default_factory is dataclasses.MISSING and f.name not in given]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        return cls(**{name: _typed(name, value, hints[name]) for name, value in given.items()})

    @classmethod
    def from_session(cls, spark: SparkSession, **more: Any) -> RunSettings:
        """Settings under ``spark.viewgrade.`` of the session, as camelCase or with underscores; ``more`` goes before them."""
        found = {key[len(PREFIX):]: value for key, value in spark.conf.getAll.items() if key.startswith(PREFIX)}
        return cls.of({**{_snake(k): v for k, v in found.items()}, **more})

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **more: Any) -> RunSettings:
        """Settings of a JSON file, or a YAML file where a YAML reader is installed, on any file system of Spark's."""
        text = spark.read.text(path, wholetext=True).first()
        text = "" if text is None else text.value
        if path.rsplit(".", 1)[-1].lower() in ("yaml", "yml"):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("no YAML reader is installed; write the settings as JSON") from e
            given = yaml.safe_load(text)
        else:
            given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError(f"{path} holds no settings by name")
        return cls.of({**given, **more})

    def resources(self) -> dict[str, str]:
        """Spark's settings for a session whose tasks get a GPU each."""
        return {"spark.executor.resource.gpu.amount": str(self.num_gpus), "spark.task.resource.gpu.amount": "1"} if self.num_gpus else {}


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _typed(name: str, value: Any, hint: Any) -> Any:
    if hint is int:
        if isinstance(value, bool) or (isinstance(value, float) and value != int(value)):
            raise ValueError(f"{name} is no whole number: {value!r}")
        try:
            return int(value)
        except (TypeError, ValueError):
            raise ValueError(f"{name} is no whole number: {value!r}") from None
    if name == "scorer_options":
        value = json.loads(value) if isinstance(value, str) else value
        if not isinstance(value, dict):
            raise ValueError(f"{name} is no mapping: {value!r}")
        return value
    if value is None and "None" in str(hint):
        return None
    if not isinstance(value, str):
        raise ValueError(f"{name} is no text: {value!r}")
    return value


def score_run(spark: SparkSession, settings: RunSettings, scorer, schema: str = "sample_id string, question string") -> DataFrame:
    """A whole run as its settings say: entries are read in order of file and place, scored where the progress log has no
    result, and written as arrays by file below ``output_dir`` with score and error.  Returns source_file, ord, sample_id, score, error.

    What failed is tried again by the next run.
    """
    from .operators.relational import first_rows
    from .operators.scoring import annotate
    from .sources.json_arrays import read_arrays
    from .sources.sinks import Progress, write_files

    rows = read_arrays(spark, settings.input_dir, schema, settings.glob_pattern, recursive=True)
    rows = rows.withColumn("source_file", F.expr(f"substring(regexp_replace(source_file, '^[a-z]+:/*', '/'), {len(_plain(settings.input_dir)) + 2})"))
    if settings.max_entries:
        rows = first_rows(rows, settings.max_entries, "source_file", "ord")
    progress = Progress(spark, settings.progress_dir)
    states = annotate(rows, scorer, settings.model_name, progress, batch=settings.batch_size).select("sample_id", "score", "error")
    done = rows.join(states, "sample_id", "left")
    write_files(done, settings.output_dir)
    return done.select("source_file", "ord", "sample_id", "score", "error")


def _plain(path: str) -> str:
    """A folder's path as it stands in the names of the files below it, without its file system."""
    import re

    return re.sub("^[a-z]+:/*", "/", path.rstrip("/"))
