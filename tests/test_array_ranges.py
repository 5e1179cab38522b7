"""JSON arrays read by byte ranges of any size, against Python's parser."""

import json
import os
import random
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewgrade.sources import array_ranges, json_arrays as J

SCHEMA = "id long, text string, list array<int>, more map<string,string>"


@pytest.fixture(params=[4000, 1 << 20])
def ranges(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(request.param))
    yield request.param
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def cut(texts, size):
    """(file, ord, text), (file, fault) of files in ranges of ``size`` bytes, as Spark would hand them to the tasks."""
    batches = []
    for name, text in texts.items():
        data = text.encode()
        parts = data.split(b"}")
        parts = parts[:-1] if parts[-1] == b"" else parts
        at = 0
        for part in parts:  # a piece belongs to the range that holds its first byte, and to the one before if it begins there
            block = max(0, -(-at // size) - 1) * size
            batches.append({"file_path": name, "block": block, "value": part.decode()})
            at += len(part) + 1
    rows = pa.Table.from_pylist(batches, pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("value", pa.string())]))
    sums = pa.Table.from_batches(list(array_ranges._sums(iter(rows.to_batches(7))))).to_pandas()
    states = pd.concat([array_ranges._settled(own) for _, own in sums.groupby("file_path")])
    known = pa.Table.from_pandas(rows.to_pandas().merge(states, on=["file_path", "block"], how="left"), preserve_index=False)
    found = [r for b in array_ranges._cut(iter(known.to_batches(5))) for r in b.to_pylist()]
    parts = defaultdict(list)
    for r in found:
        if r["ord"] is not None:
            parts[r["file_path"], r["ord"]].append((r["block"] if r["seq"] is not None else 0, r["seq"] or 0, r["value"]))
    bad = {r["file_path"] for r in found if r["fault"]}
    return {k: "".join(v for *_, v in sorted(x)) for k, x in parts.items() if k[0] not in bad}, bad


@pytest.mark.parametrize("size", [1, 3, 17, 60, 400, 1 << 20])
def test_any_ranges(size):
    arrays = {f"f{k}": records(n, k) for k, n in enumerate((0, 1, 7, 90))}
    texts = {name: json.dumps(rows, ensure_ascii=k % 2 == 0, indent=k if k > 1 else None) + "\n" * k for k, (name, rows) in enumerate(arrays.items())}
    found, bad = cut(texts | {f"bad{k}": t for k, t in enumerate(FAULTY) if t and k not in SYNTAX}, size)
    assert {k: json.loads(v) for k, v in found.items()} == {(name, i): r for name, rows in arrays.items() for i, r in enumerate(rows)}
    assert bad == {f"bad{k}" for k, t in enumerate(FAULTY) if t and k not in SYNTAX}


def records(n, seed):
    rng = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "😀", "\n", " ", "a", "\\\\", '\\"', "}]", '"}', " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 60 if rng.random() < 0.95 else 900)))
    return [{"id": i, "text": text(), "list": [rng.randint(0, 9) for _ in range(rng.randint(0, 4))], "more": {text(): text()}} if rng.random() < 0.9 else {} for i in range(n)]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_records_and_places(spark, tmp_path, ranges):
    arrays = {f"f{k}": records(n, k) for k, n in enumerate((0, 1, 7, 90))}
    for k, (name, rows) in enumerate(arrays.items()):
        put(f"{tmp_path}/{name}.json", json.dumps(rows, ensure_ascii=k % 2 == 0, indent=k if k > 1 else None) + "\n" * k)
    got = J.read_arrays(spark, str(tmp_path), SCHEMA, "*.json")
    for r in got.collect():
        want = arrays[os.path.basename(r.source_file)[:-5]][r.ord]
        assert (r.id, r.text, r.list, r.more) == tuple(want.get(c) for c in ("id", "text", "list", "more"))
    assert got.count() == 98 and got.select("source_file", "ord").distinct().count() == 98
    counts = {os.path.basename(r.file_path): r.records for r in J.file_counts(spark, str(tmp_path)).collect()}
    assert counts == {f"{name}.json": len(rows) for name, rows in arrays.items()}
    name = f"{tmp_path}/f3.json"
    assert [r.id for r in J.read_chunk(spark, name, 40, 60, SCHEMA).orderBy("ord").collect()] == [arrays["f3"][i].get("id") for i in range(40, 60)]
    with pytest.raises(IndexError):
        J.read_chunk(spark, name, 40, 91)


FAULTY = ["", "  ", "{}", '{"a": [1]}', "[", '[{"a": 1}', '[{"a": 1}]]', '[{"a": 1},]', '[,{"a": 1}]', '[{"a": 1} {"a": 2}]', "[1]", '["x"]', "[[]]", "[null]", '[{"a": 1}, 2]', '[{"a": 1}] x', '[{"a": 1}][]', "[]{}", '[{"a": "x]', '[{"a": [1}]}]', '[{"a": }]', '"[]"', "]", '[{"a": 1}}', "[}]", '[{"a": "}"]', '[{"a": 1}, {"b" 2}]', '[{"a": 1};{"a": 2}]']


SYNTAX = {k for k, t in enumerate(FAULTY) if t in ('[{"a": [1}]}]', '[{"a": }]', '[{"a": 1}, {"b" 2}]')}  # within a record: for the parser


def test_faulty_files(spark, tmp_path, ranges):
    for k, text in enumerate(FAULTY):
        put(f"{tmp_path}/all/bad{k}.json", text)
    fine = [" [ ] ", '[{"a": 1}]', '\n[\n{"a": "]}[{"},\t{}]\n']
    for k, text in enumerate(fine):
        put(f"{tmp_path}/all/fine{k}.json", text)
    found = {os.path.basename(r.file_path): (r.valid, r["count"], r.warning) for r in J.validate_files(spark, f"{tmp_path}/all").collect()}
    assert found == {f"bad{k}.json": (False, 0, "Not a JSON array") for k in range(len(FAULTY))} | {f"fine{k}.json": (True, k, None) for k in range(3)}
    assert J.read_arrays(spark, f"{tmp_path}/all", "a string", "*.json", on_other="skip").count() == 3
    for k in (0, 5, 26):
        with pytest.raises(Exception, match="not a JSON array"):
            J.read_arrays(spark, f"{tmp_path}/all", "a string", f"bad{k}.json").collect()


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": i, "text": "x{[\\\"" * 40} for i in range(60_000)]
    put(f"{tmp_path}/large.json", json.dumps(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        got = J.read_arrays(spark, f"{tmp_path}/large.json", SCHEMA, "*.json")
        assert array_ranges.pieces(spark, f"{tmp_path}/large.json", "*", False).rdd.getNumPartitions() > 8
        task = got.select("id", "ord", F.spark_partition_id().alias("p"))
        assert task.select("p").distinct().count() > 8
        assert task.where("id <> ord").isEmpty() and task.count() == 60_000
        # beyond the bound of a broadcast, the states meet their ranges by a sort
        array_ranges.BROADCAST_BYTES, kept = 0, array_ranges.BROADCAST_BYTES
        try:
            sorted_ = J.read_arrays(spark, f"{tmp_path}/large.json", SCHEMA, "*.json")
            assert sorted_.where("id <> ord").isEmpty() and sorted_.count() == 60_000
        finally:
            array_ranges.BROADCAST_BYTES = kept
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
