"""Deterministic views of the test tables as dataset rows, in Spark and as DuckDB SQL.

Attributes are drawn from salted md5 digests, so that all combinations occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import DATASETS, DISTORTIONS, LEVELS, SUBTASKS
from ..functions import strings

CODES = sorted(SUBTASKS)
NAMES = list(DISTORTIONS)
MODELS = ["m0", "m1", "m2", "m3"]


def pick(salt: str, key: Column, n: int) -> Column:
    return F.pmod(strings.md5_low32(F.concat(F.lit(salt), key.cast("string"))), F.lit(n))


def pick_sql(salt: str, key: str, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 25, 8))::BIGINT % {n})"


def choose(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def choose_sql(values: list, index: str) -> str:
    return f"({sql_list(values)})[{index} + 1]"


def sql_list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def title(code: str) -> str:
    return f"{code} " + SUBTASKS[code].replace("_", " ").title()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """events as flat samples, one a row."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    key = F.col("event_id")
    e = e.select(
        key.alias("ord"), "value", choose(DATASETS, pick("dataset", key, 4)).alias("dataset"), F.when(pick("split", key, 10) == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit("scene/"), F.col("user_id").cast("string")).alias("sequence_frame"), choose([title(c) for c in CODES], pick("subtask", key, 14)).alias("question_type"),
        choose([SUBTASKS[c] for c in CODES], pick("subtask", key, 14)).alias("subtask_type"), choose(NAMES, pick("distortion", key, 36)).alias("distortion"),
        choose(LEVELS, pick("level", key, 5)).cast("int").alias("level"), (pick("uav", key, 3) + 1).alias("uav"), (pick("target", key, 1000) / 1000.0).alias("target"), (pick("score", key, 500) / 500.0).alias("score"))
    return e.withColumn("question_id", F.concat(F.col("dataset"), F.lit("_QA_UAV"), F.col("uav").cast("string"), F.lit("_"), F.col("ord").cast("string"))).withColumn("category", strings.distortion_category(F.col("distortion")))


_CATEGORY = "CASE distortion " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in DISTORTIONS.items()) + " END"
ENTRIES = f"""entries AS (
  SELECT *, dataset || '_QA_UAV' || uav || '_' || ord AS question_id, {_CATEGORY} AS category FROM (
    SELECT event_id AS ord, value, {choose_sql(DATASETS, pick_sql('dataset', 'event_id', 4))} AS dataset,
      CASE WHEN {pick_sql('split', 'event_id', 10)} = 0 THEN 'test' ELSE 'train' END AS split,
      'scene/' || user_id AS sequence_frame, {choose_sql([title(c) for c in CODES], pick_sql('subtask', 'event_id', 14))} AS question_type,
      {choose_sql([SUBTASKS[c] for c in CODES], pick_sql('subtask', 'event_id', 14))} AS subtask_type,
      {choose_sql(NAMES, pick_sql('distortion', 'event_id', 36))} AS distortion,
      CAST({choose_sql(LEVELS, pick_sql('level', 'event_id', 5))} AS INTEGER) AS level, {pick_sql('uav', 'event_id', 3)} + 1 AS uav,
      {pick_sql('target', 'event_id', 1000)} / 1000.0::DOUBLE AS target, {pick_sql('score', 'event_id', 500)} / 500.0::DOUBLE AS score FROM events))"""


def model_scores(e: DataFrame) -> DataFrame:
    """Scores of four models by sample; two in ten samples are scored by none, some models twice."""
    models = F.explode(F.array(*map(F.lit, MODELS)))
    rows = e.where(pick("scored", F.col("ord"), 10) >= 2).select(F.col("ord").alias("sample_id"), models.alias("model"))
    key = F.concat(F.col("model"), F.lit("-"), F.col("sample_id").cast("string"))
    rows = rows.withColumn("score", pick("ms", key, 1000) / 1000.0).withColumn("ord", F.lit(0))
    again = rows.where(pick("again", key, 5) == 0).withColumn("score", pick("ms2", key, 1000) / 1000.0).withColumn("ord", F.lit(1))
    return rows.unionByName(again)


_KEY = "model || '-' || sample_id"
SCORES = f"""scores AS (
  WITH r AS (SELECT ord AS sample_id, unnest({sql_list(MODELS)}) AS model FROM entries WHERE {pick_sql('scored', 'ord', 10)} >= 2)
  SELECT sample_id, model, {pick_sql('ms', f'({_KEY})', 1000)} / 1000.0::DOUBLE AS score, 0 AS ord FROM r
  UNION ALL SELECT sample_id, model, {pick_sql('ms2', f'({_KEY})', 1000)} / 1000.0::DOUBLE, 1 FROM r WHERE {pick_sql('again', f'({_KEY})', 5)} = 0)"""


def preds(e: DataFrame) -> DataFrame:
    return e.select(F.col("ord").alias("id"), F.col("score").alias("pred"), "target", F.col("subtask_type").alias("task"), "distortion")


PREDS = "preds AS (SELECT ord AS id, score AS pred, target, subtask_type AS task, distortion FROM entries)"


def ranked_metrics_sql(by: str, source: str = "preds", pred: str = "pred", target: str = "target") -> str:
    """srcc, plcc, rmse and n of each group, from first principles."""
    tie = lambda c: f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
    return f"""SELECT {by}, CASE WHEN count(*) < 3 THEN 0 ELSE corr(rp, rt) END AS srcc, CASE WHEN count(*) < 3 THEN 0 ELSE corr(p, t) END AS plcc,
      CASE WHEN count(*) < 3 THEN 0 ELSE sqrt(avg((p - t) * (p - t))) END AS rmse, count(*) AS n
    FROM (SELECT {by}, {pred} AS p, {target} AS t, {tie(pred)} AS rp, {tie(target)} AS rt FROM {source}) GROUP BY {by}"""


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns as reference and hypothesis, all tokens of each."""
    from ..functions import text

    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("ref")).join(nxt, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", text.tokens(F.col("ref")).alias("ref"), text.tokens(F.col("hyp")).alias("hyp"))


PAIRS = r"""pairs AS (
  SELECT a.conv_id, a.turn, list_filter(regexp_split_to_array(lower(a.text), '\s+'), lambda x: x <> '') AS ref,
    list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '') AS hyp
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


#: Drawn images: squares in a row and a column, and pixels in a square's row and column.
SQUARES, SQUARE = 4, 8
SIDE = SQUARES * SQUARE


def mosaic(key: Column) -> Column:
    """RGB bytes of SIDE x SIDE pixels: squares whose colours are digits of the key's digests, a digest for a row of squares."""
    lines = []
    for r in range(SQUARES):
        digest = F.md5(F.concat(key, F.lit(f"/{r}")).cast("binary"))
        colours = [F.repeat(F.substring(digest, 6 * c + 1, 6), SQUARE) for c in range(SQUARES)]
        lines.append(F.repeat(F.concat(*colours), SQUARE))
    return F.unhex(F.concat(*lines))


def squares(key: Column) -> Column:
    """``mosaic`` with a pixel for each square."""
    return F.unhex(F.concat(*(F.substring(F.md5(F.concat(key, F.lit(f"/{r}")).cast("binary")), 1, 6 * SQUARES) for r in range(SQUARES))))


def squares_sql(rows: str, key: str) -> str:
    """Rows by square of their mosaic: s, and the bytes r8, g8, b8 of its colour."""
    byte = lambda k: f"('0x' || substr(md5({key} || '/' || (s // {SQUARES})), (s % {SQUARES}) * 6 + {k}, 2))::INTEGER"
    return f"SELECT *, {byte(1)} AS r8, {byte(3)} AS g8, {byte(5)} AS b8 FROM {rows}, range({SQUARES**2}) t(s)"


def images(df: DataFrame, key: Column) -> DataFrame:
    """Rows with a mosaic of their own."""
    return df.withColumns({"image": mosaic(key), "h": F.lit(SIDE), "w": F.lit(SIDE)})


def portraits(spark: SparkSession, d: str) -> DataFrame:
    """supplier as images: name, image, h, w."""
    return images(table(spark, d, "supplier").select(F.col("s_suppkey").alias("name")), F.concat(F.lit("supplier/"), F.col("name").cast("string")))


def views(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """events as images of views, once each: dataset, frame, distortion, view, further columns, seed, image, h, w, where a pixel is a square of SQUARE pixels a side."""
    e = entries(spark, d).select("dataset", F.col("sequence_frame").alias("frame"), "distortion", F.col("uav").alias("view"), *more).distinct()
    e = e.withColumn("seed", strings.distortion_seed(F.col("dataset"), F.col("frame"), F.col("distortion")).cast("long"))
    return e.withColumns({"image": squares(F.concat_ws("/", "dataset", "frame", F.col("view").cast("string"))), "h": F.lit(SQUARES), "w": F.lit(SQUARES)})
