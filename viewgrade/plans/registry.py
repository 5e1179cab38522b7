"""Registered queries of the engine, named after what they do, each with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import DATASETS, DISTORTIONS, LEVELS, PRINTABLE, REPORT_CATEGORY, SUBTASKS, TASK_GROUPS, UAV_DISTORTIONS
from ..functions import stats, strings, text
from ..operators import relational as R
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH {A.ENTRIES}"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def case_of(table: dict, column: str, default: str) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


UAV_SQL = "(" + ", ".join(f"'{x}'" for x in UAV_DISTORTIONS) + ")"

# ---- scalars --------------------------------------------------------------------------------------------


@query("identifier_rules", WITH + f"""
SELECT ord, regexp_extract(question_type, '^(\\d+\\.\\d+)', 1) AS code, CAST({case_of({c: i for i, c in enumerate(A.CODES)}, "regexp_extract(question_type, '^(\\d+\\.\\d+)', 1)", '0')} AS INTEGER) AS subtask_id,
  subtask_type AS subtask_name, 'UAV' || uav AS view_id, category,
  dataset || '__' || split || '__' || replace(sequence_frame, '/', '_') || '__' || question_id || '__' || distortion || '_L' || lpad(CAST(level AS VARCHAR), 2, '0') AS full_id,
  dataset || '__' || replace(sequence_frame, '/', '_') || '__' || distortion || '_L' || lpad(CAST(level AS VARCHAR), 2, '0') AS short_id,
  (42 + (('0x' || substr(md5(dataset || '__' || sequence_frame || '__' || distortion), 25, 8))::BIGINT & 2147483647)) % 2147483648 AS seed,
  {case_of({m: g for g, ms in TASK_GROUPS.items() for m in ms}, "substr(question_type, 5)", 'NULL')} AS task_group
FROM entries""")
def identifier_rules(spark, d):
    """F3-F7, F9, F23, J8, J9."""
    c = F.col
    return A.entries(spark, d).select(
        "ord", strings.subtask_code(c("question_type")).alias("code"), strings.subtask_id(c("question_type")).alias("subtask_id"), strings.subtask_name(c("question_type")).alias("subtask_name"),
        strings.view_id(c("question_id"), c("question_type")).alias("view_id"), strings.distortion_category(c("distortion")).alias("category"),
        strings.sample_id(c("dataset"), c("sequence_frame"), c("distortion"), c("level"), c("split"), c("question_id")).alias("full_id"), strings.sample_id(c("dataset"), c("sequence_frame"), c("distortion"), c("level")).alias("short_id"),
        strings.distortion_seed(c("dataset"), c("sequence_frame"), c("distortion")).alias("seed"), strings.task_group(F.substring("question_type", 5, 100)).alias("task_group"))


@query("distortion_keys", WITH + """
SELECT ord, distortion, level / 10.0::DOUBLE AS intensity, replace(dataset || '/' || sequence_frame, '/', '_') AS ref_id, dataset AS dataset_name, level AS level_of, 'q' || ord AS stem
FROM entries""")
def distortion_keys(spark, d):
    """F1, F2, F8, F11, F12, F16."""
    e = A.entries(spark, d)
    c = F.col
    key = F.concat(F.lit("x/"), strings.sample_id(c("dataset"), c("sequence_frame"), c("distortion"), c("level")), F.lit(".png"))
    name, intensity = strings.distortion_key(key)
    path = F.concat(F.lit("/"), c("dataset"), F.lit("\\"), c("sequence_frame"), F.lit(".jpg"))
    return e.select("ord", name.alias("distortion"), intensity.alias("intensity"), strings.reference_id(path).alias("ref_id"), strings.dataset_name(F.concat(c("dataset"), F.lit("_VQA_train.json"))).alias("dataset_name"),
                    strings.level_of(c("level") / 10 + 0.01).alias("level_of"), strings.path_stem(F.concat(F.lit("a/b.c/q"), c("ord").cast("string"), F.lit(".tar"))).alias("stem"))


_HUMAN = "CASE quality WHEN 1 THEN 'Good (4/5)' WHEN 0 THEN 'Poor (2/5)' END"


@query("human_scores", f"""
SELECT doc_id, coalesce(try_cast(nullif(regexp_extract({_HUMAN}, '\\((\\d+)/5\\)', 1), '') AS DOUBLE) / 5, 0.5) AS quality_score,
  CASE toxic WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 END::DOUBLE AS usability_score,
  round(0.4 * coalesce(try_cast(nullif(regexp_extract({_HUMAN}, '\\((\\d+)/5\\)', 1), '') AS DOUBLE) / 5, 0.5) + 0.6 * (CASE toxic WHEN 0 THEN 1.0 ELSE 0.25 END), 6)::DOUBLE AS human_score
FROM labels""")
def human_scores(spark, d):
    """F13-F15."""
    quality = F.when(F.col("quality") == 1, "Good (4/5)").when(F.col("quality") == 0, "Poor (2/5)")
    usable = F.when(F.col("toxic") == 0, " 1 (Available)").otherwise("3")
    return A.table(spark, d, "labels").select("doc_id", strings.quality_score(quality).alias("quality_score"), strings.usability_score(usable).alias("usability_score"), F.round(strings.human_score(quality, usable), 6).alias("human_score"))


@query("human_agreement", """
SELECT source, count(*) AS n, round(avg(0.4 * (CASE quality WHEN 1 THEN 0.8 ELSE 0.4 END) + 0.6 * (CASE toxic WHEN 0 THEN 1.0 ELSE 0.25 END)), 6)::DOUBLE AS mean_human
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def human_agreement(spark, d):
    """Inner join with the human reference scores."""
    return A.table(spark, d, "documents").select("doc_id", "source").join(human_scores(spark, d), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("human_score"), 6).alias("mean_human"))


@query("prompts_and_durations", WITH + """
SELECT ord, question_id || chr(10) || 'Answer concisely in 2-4 sentences.' AS prompt, repeat('<img>', uav) || 'Q: ' || question_id AS chat, 'a/' || dataset || '__' || lpad(CAST(level AS VARCHAR), 4, '0') AS task_id,
  CASE WHEN ord < 60 THEN ord || 's' WHEN ord < 3600 THEN (ord // 60) || 'm ' || lpad(CAST(ord % 60 AS VARCHAR), 2, '0') || 's'
    ELSE (ord // 3600) || 'h ' || lpad(CAST(ord // 60 % 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(ord % 60 AS VARCHAR), 2, '0') || 's' END AS duration
FROM entries""")
def prompts_and_durations(spark, d):
    """F17-F19, F21."""
    c = F.col
    return A.entries(spark, d).select("ord", strings.prompt_text(c("question_id")).alias("prompt"), strings.chat_prompt(F.when(c("uav") == 1, "{image_tags}Q: {prompt}").otherwise("Q: {prompt}"), c("question_id"), c("uav").cast("int"), "<img>").alias("chat"),
                                      strings.task_id(F.concat(F.lit("a/"), c("dataset"), F.lit(".json")), c("level")).alias("task_id"), strings.duration(c("ord")).alias("duration"))


@query("character_ids", f"""
SELECT item_id, list_transform(list_filter(string_split(substr(text, 1, 256), ''), lambda x: x <> ''),
  lambda c: CAST(CASE WHEN strpos('{PRINTABLE.replace("'", "''")}', c) > 0 THEN strpos('{PRINTABLE.replace("'", "''")}', c) + 1 ELSE 1 END AS INTEGER)) AS ids
FROM benchmark""")
def character_ids(spark, d):
    """F22."""
    return A.table(spark, d, "benchmark").select("item_id", strings.char_ids(F.col("text")).alias("ids"))


# ---- text similarity ------------------------------------------------------------------------------------

_GRAM = lambda x, n: f"(CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' ')) ELSE []::VARCHAR[] END)"
_TIMES = lambda bag, g: f"len(list_filter({bag}, lambda y: y = {g}))"
_GRAMS = "grams AS (SELECT *, " + ", ".join(f"{_GRAM('ref', n)} AS r{n}, {_GRAM('hyp', n)} AS h{n}" for n in (1, 2, 3, 4)) + " FROM pairs)"
_HIT = lambda n: f"coalesce(list_sum(list_transform(list_distinct(h{n}), lambda g: least({_TIMES(f'h{n}', 'g')}, {_TIMES(f'r{n}', 'g')}))), 0)"
_P = lambda n: f"ln(greatest(CASE WHEN len(r{n}) = 0 OR len(h{n}) = 0 THEN 0.0 WHEN {_HIT(n)} = 0 THEN 1.0 / (len(h{n}) + 1) ELSE {_HIT(n)} / len(h{n})::DOUBLE END, 1e-10))"
_BLEU = f"CASE WHEN len(hyp) = 0 THEN 0.0 ELSE least(1.0, (CASE WHEN len(hyp) > len(ref) THEN 1.0 ELSE exp(1 - len(ref) / greatest(len(hyp), 1)::DOUBLE) END) * exp(({' + '.join(_P(n) for n in (1, 2, 3, 4))}) / 4)) END"


@query("bleu", f"WITH {A.PAIRS}, {_GRAMS} SELECT conv_id, turn, len(ref) AS n_ref, len(hyp) AS n_hyp, CAST({_HIT(2)} AS BIGINT) AS bigram_hits, round({_BLEU}, 6)::DOUBLE AS bleu FROM grams")
def bleu(spark, d):
    """T1, T2, T4."""
    p, c = A.text_pairs(spark, d), F.col
    return p.select("conv_id", "turn", F.size("ref").cast("long").alias("n_ref"), F.size("hyp").cast("long").alias("n_hyp"), text.gram_hits("ref", "hyp")[1]["hits"].cast("long").alias("bigram_hits"), F.round(text.bleu(c("ref"), c("hyp")), 6).alias("bleu"))


_LCS = """lcs AS (
  SELECT conv_id, turn, ref, hyp, 0 AS i, list_transform(range(0, len(hyp) + 1), lambda j: 0) AS row FROM pairs
  UNION ALL
  SELECT conv_id, turn, ref, hyp, i + 1, list_reduce(range(1, len(hyp) + 1), lambda acc, j: list_append(acc, CASE WHEN hyp[j] = ref[i + 1] THEN row[j] + 1 ELSE greatest(acc[len(acc)], row[j + 1]) END), [0])
  FROM lcs WHERE i < len(ref))"""
_RECURSIVE_LCS = f"WITH RECURSIVE {A.PAIRS}, {_LCS}"


@query("rouge_l", _RECURSIVE_LCS + """
SELECT conv_id, turn, CAST(row[len(hyp) + 1] AS INTEGER) AS lcs,
  round(CASE WHEN row[len(hyp) + 1] = 0 THEN 0.0 ELSE 2.0 * row[len(hyp) + 1] / (len(ref) + len(hyp)) END, 6)::DOUBLE AS rouge_l
FROM lcs WHERE i = len(ref)""")
def rouge_l(spark, d):
    """The LCS runs as an Arrow function, once a pair."""
    p = A.text_pairs(spark, d).withColumn("lcs", text.lcs("ref", "hyp"))
    return p.select("conv_id", "turn", "lcs", F.round(text.rouge_l(F.col("lcs"), F.col("ref"), F.col("hyp")), 6).alias("rouge_l"))


_BAG = "bags AS (SELECT conv_id, turn, list_concat(list_concat(r1, r2), list_concat(r3, r4)) AS a, list_concat(list_concat(h1, h2), list_concat(h3, h4)) AS b FROM grams)"
_IDF = "pow(1 + ln(1.5), 2)"
_NORM = lambda x, y: f"sqrt(coalesce(list_sum(list_transform(list_distinct({x}), lambda g: pow({_TIMES(x, 'g')}, 2) * CASE WHEN list_contains({y}, g) THEN 1.0 ELSE {_IDF} END)), 0))"


@query("cider", f"""WITH {A.PAIRS}, {_GRAMS}, {_BAG}
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 10 * coalesce(list_sum(list_transform(list_distinct(list_filter(a, lambda g: list_contains(b, g))), lambda g: {_TIMES('a', 'g')} * {_TIMES('b', 'g')})), 0) / ({_NORM('a', 'b')} * {_NORM('b', 'a')}) END, 5)::DOUBLE AS cider FROM bags""")
def cider(spark, d):
    """T8 for one reference."""
    return A.text_pairs(spark, d).select("conv_id", "turn", F.round(text.cider(F.col("ref"), F.col("hyp")), 5).alias("cider"))


@query("tf_idf", r"""WITH words AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM benchmark),
tf AS (SELECT item_id, word, count(*) AS c FROM words GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), n AS (SELECT count(*) AS n FROM benchmark), t AS (SELECT item_id, sum(c) AS total FROM tf GROUP BY item_id)
SELECT item_id, word, round(c / total::DOUBLE * (ln((n + 1) / (df + 1)::DOUBLE) + 1), 8)::DOUBLE AS tf_idf FROM tf JOIN df USING (word) JOIN t USING (item_id), n""")
def tf_idf(spark, d):
    """T6 for a corpus: term counts, document counts and their product, as grouped aggregates and joins."""
    b = A.table(spark, d, "benchmark")
    tf = b.select("item_id", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = tf.groupBy("item_id").agg(F.sum("c").alias("total"))
    n = b.count()
    return tf.join(df, "word").join(total, "item_id").select("item_id", "word", F.round(F.col("c") / F.col("total") * text.idf(F.lit(n), F.col("df")), 8).alias("tf_idf"))


#: All three similarities of pairs (conv_id, turn, ref, hyp), whole texts.
_CIDER = f"CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 10 * coalesce(list_sum(list_transform(list_distinct(list_filter(a, lambda g: list_contains(b, g))), lambda g: {_TIMES('a', 'g')} * {_TIMES('b', 'g')})), 0) / ({_NORM('a', 'b')} * {_NORM('b', 'a')}) END"


def _sims(pairs: str) -> str:
    return f"""WITH RECURSIVE {pairs}, {_LCS}, {_GRAMS}, {_BAG},
l AS (SELECT conv_id, turn, CASE WHEN row[len(hyp) + 1] = 0 THEN 0.0 ELSE 2.0 * (row[len(hyp) + 1] / len(ref)::DOUBLE) * (row[len(hyp) + 1] / len(hyp)::DOUBLE) / (row[len(hyp) + 1] / len(ref)::DOUBLE + row[len(hyp) + 1] / len(hyp)::DOUBLE) END AS rouge FROM lcs WHERE i = len(ref)),
g AS (SELECT conv_id, turn, {_BLEU} AS bleu FROM grams), c AS (SELECT conv_id, turn, {_CIDER} AS cider FROM bags),
sims AS (SELECT * FROM g JOIN l USING (conv_id, turn) JOIN c USING (conv_id, turn))"""


@query("cognitive_scores", _sims(A.PAIRS) + " SELECT conv_id, turn, round((bleu + rouge + 0.1 * cider) / 2.1, 6)::DOUBLE AS combined, round(bleu + rouge + 0.1 * cider, 6)::DOUBLE AS plain, round(least(greatest(bleu / greatest(rouge, 1e-6), 0), 1), 6)::DOUBLE AS kept FROM sims")
def cognitive_scores(spark, d):
    """The three ways that similarities are combined, with each pair's own ones."""
    p, c = A.text_pairs(spark, d).withColumn("lcs", text.lcs("ref", "hyp")), F.col
    s = p.select("conv_id", "turn", text.bleu(c("ref"), c("hyp")).alias("bleu"), text.rouge_l(c("lcs"), c("ref"), c("hyp")).alias("rouge"), text.cider(c("ref"), c("hyp")).alias("cider"))
    parts = c("bleu"), c("rouge"), c("cider")
    return s.select("conv_id", "turn", F.round(text.combined(*parts), 6).alias("combined"), F.round(text.combined(*parts, normalised=False), 6).alias("plain"), F.round(text.against_truth(c("bleu"), c("rouge")), 6).alias("kept"))


@query("conversation_scores", _sims(A.PAIRS) + " SELECT conv_id, round_even(avg(bleu), 6)::DOUBLE AS bleu, round_even(avg(rouge), 6)::DOUBLE AS rouge_l, round_even(avg(cider), 6)::DOUBLE AS cider, round_even((avg(bleu) + avg(rouge) + 0.1 * avg(cider)) / 2.1, 6)::DOUBLE AS cognitive_score, count(*) AS n_prompts FROM sims GROUP BY conv_id")
def conversation_scores(spark, d):
    """Means over a conversation's prompts."""
    c = A.table(spark, d, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("ref_text")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("dist_text")), ["conv_id", "turn"])
    return text.cognitive_scores(pairs, "conv_id")


_TOKENS = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda x: x <> '')"
_TRIPLES = f"""triples AS (SELECT a.conv_id, a.turn, {_TOKENS('a.text')} AS gt, {_TOKENS('b.text')} AS r, {_TOKENS('c.text')} AS d
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2),
pairs AS (SELECT conv_id * 4 AS conv_id, turn, gt AS ref, r AS hyp FROM triples UNION ALL SELECT conv_id * 4 + 1, turn, gt, d FROM triples UNION ALL SELECT conv_id * 4 + 2, turn, r, d FROM triples)"""
_SHARE = lambda x: f"least(greatest(d.{x} / greatest(r.{x}, 1e-6), 0), 1)"


def _answers(spark, d):
    """A turn as the truth, the next one as the clean answer and the one after as the distorted."""
    c = A.table(spark, d, "conversations")
    shifted = lambda k, name: c.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name))
    return shifted(0, "gt_answer").join(shifted(1, "ref_answer"), ["conv_id", "turn"]).join(shifted(2, "dist_answer"), ["conv_id", "turn"])


@query("truth_scores", _sims(_TRIPLES) + f""" SELECT r.conv_id // 4 AS conv_id, r.turn, round_even({_SHARE('bleu')}, 6)::DOUBLE AS kept_bleu, round_even({_SHARE('rouge')}, 6)::DOUBLE AS kept_rouge,
  round_even(({_SHARE('bleu')} + {_SHARE('rouge')} + 0.1 * {_SHARE('cider')}) / 2.1, 6)::DOUBLE AS metric1, round_even((x.bleu + x.rouge + 0.1 * x.cider) / 2.1, 6)::DOUBLE AS metric2, r.bleu < 1e-6 AS baseline_failed
FROM sims r JOIN sims d ON d.conv_id = r.conv_id + 1 AND d.turn = r.turn JOIN sims x ON x.conv_id = r.conv_id + 2 AND x.turn = r.turn WHERE r.conv_id % 4 = 0""")
def truth_scores(spark, d):
    """Both metrics against a truth, with the flag of a failed baseline."""
    t = text.with_truth(_answers(spark, d))
    return t.select("conv_id", "turn", F.col("metric1_bleu").alias("kept_bleu"), F.col("metric1_rouge_l").alias("kept_rouge"), "metric1", "metric2", "baseline_failed")


_UNNESTED = """grams AS (SELECT k, g, count(*)::DOUBLE AS c FROM (
  SELECT k, unnest(list_concat(w, list_concat(g2, list_concat(g3, g4)))) AS g FROM (
    SELECT k, w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE [] END AS g2,
      CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END AS g3,
      CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [] END AS g4 FROM texts)) GROUP BY k, g)"""


@query("tf_idf_all_orders", f"""WITH texts AS (SELECT item_id AS k, {_TOKENS('text')} AS w FROM benchmark), {_UNNESTED},
df AS (SELECT g, count(*) AS df FROM grams GROUP BY g), total AS (SELECT k, sum(c) AS t FROM grams GROUP BY k), n AS (SELECT count(*) AS n FROM texts)
SELECT k AS item_id, g AS gram, round(c / t * (ln((n + 1) / (df + 1)::DOUBLE) + 1), 8)::DOUBLE AS tf_idf FROM grams JOIN df USING (g) JOIN total USING (k), n""")
def tf_idf_all_orders(spark, d):
    """N-grams of orders 1 to 4 pooled."""
    docs = A.table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("tokens"))
    return rounded(text.tf_idf(docs, "item_id"), "tf_idf", digits=8)


@query("cider_of_corpus", f"""WITH texts AS (SELECT -1 - item_id AS k, {_TOKENS('text')} AS w FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, {_TOKENS('text')} FROM conversations), {_UNNESTED},
n AS (SELECT count(*) AS n FROM benchmark), df AS (SELECT g, count(*) FILTER (k < 0) AS df FROM grams GROUP BY g), w AS (SELECT k, g, c, df, ln((n + 2) / (df + 1.0)) + 1 AS plain, ln((n + 2) / (df + 2.0)) + 1 AS more FROM grams JOIN df USING (g), n),
base AS (SELECT k AS doc, sum(pow(c * plain, 2)) AS base FROM w WHERE k < 0 GROUP BY k), norm AS (SELECT k AS hyp, sqrt(sum(pow(c * more, 2))) AS norm FROM w WHERE k >= 0 GROUP BY k),
met AS (SELECT h.k AS hyp, d.k AS doc, sum(h.c * d.c * pow(h.more, 2)) AS dot, sum(pow(d.c, 2) * (pow(d.more, 2) - pow(d.plain, 2))) AS change FROM w h JOIN w d ON h.g = d.g AND h.k >= 0 AND d.k < 0 GROUP BY ALL),
s AS (SELECT hyp, sum(dot / (sqrt(base + change) * norm)) AS s FROM met JOIN base USING (doc) JOIN norm USING (hyp) GROUP BY hyp)
SELECT conv_id, turn, round(10 * coalesce(s, 0) / n, 5)::DOUBLE AS cider FROM conversations LEFT JOIN s ON hyp = conv_id * 1000 + turn, n""")
def cider_of_corpus(spark, d):
    """T8, T9 with a corpus: every turn against all benchmark texts."""
    hyps = A.table(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("hyp_id"), text.tokens(F.col("text")).alias("tokens"))
    corpus = A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), text.tokens(F.col("text")).alias("tokens"))
    return rounded(text.cider_of_corpus(hyps.select("hyp_id", "tokens"), corpus).select("hyp_id.conv_id", "hyp_id.turn", "cider"), "cider", digits=5)


@query("cider_of_references", f"""WITH texts AS (SELECT conv_id * 1000 + turn AS k, {_TOKENS('text')} AS w FROM conversations), {_UNNESTED},
docs AS (SELECT conv_id, turn, conv_id * 1000 + turn AS k, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
df AS (SELECT conv_id, g, count(*) AS df FROM docs JOIN grams USING (k) GROUP BY ALL), w AS (SELECT conv_id, turn, last, n, g, c * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS v FROM docs JOIN grams USING (k) JOIN df USING (conv_id, g)),
norm AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM w GROUP BY ALL),
cos AS (SELECT r.conv_id, r.turn, sum(r.v * h.v) AS dot FROM w r JOIN w h ON r.conv_id = h.conv_id AND r.g = h.g AND h.turn = h.last AND r.turn < r.last GROUP BY ALL),
s AS (SELECT c.conv_id, sum(dot / (a.norm * b.norm)) AS s FROM cos c JOIN norm a ON a.conv_id = c.conv_id AND a.turn = c.turn JOIN (SELECT DISTINCT conv_id, last FROM docs) l ON l.conv_id = c.conv_id JOIN norm b ON b.conv_id = c.conv_id AND b.turn = last GROUP BY 1)
SELECT DISTINCT conv_id, round(CASE WHEN n < 2 THEN 0 ELSE 10 * coalesce(s, 0) / (n - 1) END, 5)::DOUBLE AS cider FROM docs LEFT JOIN s USING (conv_id)""")
def cider_of_references(spark, d):
    """T8 with several references: a conversation's last turn against all turns before it."""
    c = A.table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    all_ = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("t"))
    words = F.transform("t", lambda x: x["w"])
    return all_.select("conv_id", F.round(text.cider_of(F.slice(words, F.lit(1), F.size("t") - 1), F.element_at(words, -1)), 5).alias("cider"))


@query("key_union_cosine", """WITH w AS (SELECT user_id, event_type, count(*)::DOUBLE AS c FROM events GROUP BY ALL), n AS (SELECT user_id, sqrt(sum(c * c)) AS norm FROM w GROUP BY 1)
SELECT a.user_id, round(coalesce((SELECT sum(x.c * y.c) FROM w x JOIN w y ON x.event_type = y.event_type AND x.user_id = a.user_id AND y.user_id = b.user_id), 0) / (a.norm * b.norm), 6)::DOUBLE AS cosine FROM n a JOIN n b ON b.user_id = a.user_id + 1""")
def key_union_cosine(spark, d):
    """Of two users' weights by event type, whatever keys either has."""
    w = A.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("c"))
    m = w.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("x"))
    return m.join(m.select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("y")), "user_id").select("user_id", F.round(text.map_cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("vector_cosine_psnr", """
WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(coalesce(list_dot_product(x, y) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 0), 0), 6)::DOUBLE AS cosine,
  round(10 * log10(1 / (list_avg(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 2))) + 1e-8)), 5)::DOUBLE AS psnr FROM p""")
def vector_cosine_psnr(spark, d):
    """T7, I39 on flat vectors."""
    v = A.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    mse = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, q: s + q) / F.size("x")
    return p.select("vec_id", F.round(text.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(10 * F.log10(1 / (mse + 1e-8)), 5).alias("psnr"))


# ---- statistics -----------------------------------------------------------------------------------------


@query("quality_by_task", WITH + f", {A.PREDS}, m AS ({A.ranked_metrics_sql('task')}), dim AS (SELECT unnest({A.sql_list([SUBTASKS[c] for c in A.CODES])}) AS task) SELECT task, round(coalesce(srcc, 0), 6)::DOUBLE AS srcc, round(coalesce(plcc, 0), 6)::DOUBLE AS plcc, round(coalesce(rmse, 0), 6)::DOUBLE AS rmse, coalesce(n, 0)::BIGINT AS n FROM dim LEFT JOIN m USING (task)")
def quality_by_task(spark, d):
    """A3-A5, A7, A8, P14."""
    return rounded(R.by_task(A.preds(A.entries(spark, d))), "srcc", "plcc", "rmse")


_TAU = lambda by, source: f"""tau AS (SELECT a.{by}, sum(sign(a.pred - b.pred) * sign(a.target - b.target)) / (sqrt(count(*) FILTER (a.pred <> b.pred)) * sqrt(count(*) FILTER (a.target <> b.target))) AS tau FROM {source} a JOIN {source} b ON a.{by} = b.{by} AND a.id < b.id GROUP BY 1)"""


@query("quality_by_distortion", WITH + f", {A.PREDS}, m AS ({A.ranked_metrics_sql('distortion')}), {_TAU('distortion', 'preds')} SELECT distortion, round(srcc, 6)::DOUBLE AS srcc, round(plcc, 6)::DOUBLE AS plcc, round(rmse, 6)::DOUBLE AS rmse, round(CASE WHEN n >= 3 THEN tau END, 6)::DOUBLE AS kendall_tau, n FROM m LEFT JOIN tau USING (distortion)")
def quality_by_distortion(spark, d):
    """A6, A7, A9."""
    return rounded(R.by_distortion(A.preds(A.entries(spark, d))), "srcc", "plcc", "rmse", "kendall_tau")


_METHODS = f"""x AS (SELECT model AS method, e.ord AS id, last.score AS pred, target, subtask_type AS task, CASE WHEN distortion IN {UAV_SQL} THEN 'UAV' ELSE 'Generic' END AS kind FROM last JOIN entries e ON sample_id = e.ord),
y AS (SELECT method || '/all/all' AS g, id, pred, target FROM x UNION ALL SELECT method || '/task/' || task, id, pred, target FROM x UNION ALL SELECT method || '/kind/' || kind, id, pred, target FROM x)"""


@query("method_report", WITH + f", {A.SCORES}, last AS (SELECT sample_id, model, arg_max(score, ord) AS score FROM scores GROUP BY ALL), {_METHODS}, m AS ({A.ranked_metrics_sql('g', 'y')}), {_TAU('g', 'y')} SELECT split_part(g, '/', 1) AS method, split_part(g, '/', 2) AS slice, split_part(g, '/', 3) AS name, round(srcc, 6)::DOUBLE AS srcc, round(plcc, 6)::DOUBLE AS plcc, round(rmse, 6)::DOUBLE AS rmse, round(CASE WHEN n >= 3 THEN tau ELSE 0 END, 6)::DOUBLE AS kendall_tau, n FROM m LEFT JOIN tau USING (g)")
def method_report(spark, d):
    """Every method's figures, overall, by subtask and by kind of distortion."""
    e, last = _stacked(spark, d)
    rows = last.join(e.select(F.col("ord").alias("sample_id"), "target", F.col("subtask_type").alias("task"), "distortion"), "sample_id")
    return rounded(R.method_report(rows.select(F.col("model").alias("method"), "task", "distortion", F.col("score").alias("pred"), "target")), "srcc", "plcc", "rmse", "kendall_tau")


_CONSOLIDATED = f"""last AS (SELECT sample_id, model, arg_max(score, ord) AS score FROM scores GROUP BY ALL), mean AS (SELECT sample_id, round(avg(score), 6) AS mean FROM last GROUP BY sample_id),
joined AS (SELECT e.ord AS id, coalesce(mean, score) AS pred, target, CASE WHEN distortion IN {UAV_SQL} THEN 'UAV' ELSE 'Generic' END AS kind FROM entries e LEFT JOIN mean ON sample_id = e.ord)"""


@query("quality_by_category", WITH + f", {A.SCORES}, {_CONSOLIDATED}, m AS ({A.ranked_metrics_sql('kind', 'joined')}) SELECT kind, round(srcc, 5)::DOUBLE AS srcc, round(plcc, 5)::DOUBLE AS plcc, round(rmse, 5)::DOUBLE AS rmse, n FROM m")
def quality_by_category(spark, d):
    """The flagship: J1 and A2 (consolidated model scores), then A10."""
    e = A.entries(spark, d)
    samples = e.withColumn("sample_id", F.col("ord")).withColumn("cognitive_score", F.col("score")).withColumn("vlm_scores", F.lit(None).cast("map<string,double>"))
    done = R.consolidate(samples, A.model_scores(e))
    return rounded(R.by_uav_or_generic(A.preds(done.withColumn("score", F.col("cognitive_score")))), "srcc", "plcc", "rmse", digits=5)


@query("score_consolidation", WITH + f", {A.SCORES}, last AS (SELECT sample_id, model, arg_max(score, ord) AS s FROM scores GROUP BY ALL), m AS (SELECT sample_id, string_agg(model || '=' || CAST(round(s * 1000) AS INTEGER), ',' ORDER BY model) AS models, round(avg(s), 6) AS mean FROM last GROUP BY sample_id) SELECT ord AS sample_id, models, round(coalesce(mean, score), 6)::DOUBLE AS cognitive_score FROM entries LEFT JOIN m ON sample_id = ord")
def score_consolidation(spark, d):
    """J1, A2, P5, J12."""
    e = A.entries(spark, d)
    samples = e.select(F.col("ord").alias("sample_id"), F.lit(None).cast("map<string,double>").alias("vlm_scores"), F.col("score").alias("cognitive_score"))
    out = R.consolidate(samples, A.model_scores(e))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("vlm_scores")), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 1000).cast("int").cast("string"))), ",")
    return out.select("sample_id", shown.alias("models"), F.round("cognitive_score", 6).alias("cognitive_score"))


@query("macro_srcc", WITH + f", {A.PREDS}, m AS ({A.ranked_metrics_sql('distortion')}) SELECT CASE WHEN distortion IN {UAV_SQL} THEN 'UAV' ELSE 'Generic' END AS kind, round(avg(srcc), 6)::DOUBLE AS macro_srcc FROM m GROUP BY 1")
def macro_srcc(spark, d):
    """A11."""
    return rounded(R.macro_srcc(A.preds(A.entries(spark, d))), "macro_srcc")


@query("tied_ranks", f"WITH x AS (SELECT l_returnflag || l_linestatus AS g, l_extendedprice AS pred, l_quantity AS target FROM lineitem), m AS ({A.ranked_metrics_sql('g', 'x')}) SELECT g, round(srcc, 5)::DOUBLE AS srcc, round(plcc, 5)::DOUBLE AS plcc, n FROM m")
def tied_ranks(spark, d):
    """A3, A4, W1 with heavy ties."""
    x = A.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_extendedprice").alias("pred"), F.col("l_quantity").alias("target"))
    return rounded(stats.quality_metrics(x, ["g"]), "srcc", "plcc", digits=5).select("g", "srcc", "plcc", "n")


@query("kendall_by_task", WITH + f""", {A.PREDS}, pairs AS (SELECT a.task, sign(a.pred - b.pred) * sign(a.target - b.target) AS s, a.pred = b.pred AS tp, a.target = b.target AS tt FROM preds a JOIN preds b ON a.task = b.task AND a.id < b.id)
SELECT task, round(sum(s) / (sqrt(count(*) FILTER (NOT tp)) * sqrt(count(*) FILTER (NOT tt))), 6)::DOUBLE AS kendall_tau FROM pairs GROUP BY task""")
def kendall_by_task(spark, d):
    """A6."""
    return rounded(stats.kendall_by(A.preds(A.entries(spark, d)), ["task"], "pred", "target"), "kendall_tau")


_STACKED = "last AS (SELECT sample_id, model, arg_max(score, ord) AS score FROM scores GROUP BY ALL)"


def _stacked(spark, d):
    e = A.entries(spark, d)
    return e, A.model_scores(e).groupBy("sample_id", "model").agg(F.max_by("score", "ord").alias("score"))


@query("level_correlation", WITH + f", {A.SCORES}, {_STACKED}, x AS (SELECT distortion || '/' || model AS g, model, level AS pred, last.score AS target FROM last JOIN entries e ON sample_id = e.ord), m AS ({A.ranked_metrics_sql('g', 'x')}) SELECT split_part(g, '/', 2) AS model, round(avg(srcc), 6)::DOUBLE AS mean_srcc, count(*) AS n FROM m GROUP BY 1")
def level_correlation(spark, d):
    """A17."""
    e, last = _stacked(spark, d)
    return rounded(R.level_correlation(last.join(e.select(F.col("ord").alias("sample_id"), "distortion", "level"), "sample_id")), "mean_srcc")


@query("model_agreement", WITH + f", {A.SCORES}, {_STACKED}, x AS (SELECT a.model || '/' || b.model AS g, a.score AS pred, b.score AS target FROM last a JOIN last b ON a.sample_id = b.sample_id AND a.model < b.model), m AS ({A.ranked_metrics_sql('g', 'x')}) SELECT split_part(g, '/', 1) AS model_a, split_part(g, '/', 2) AS model_b, round(srcc, 6)::DOUBLE AS srcc, n FROM m")
def model_agreement(spark, d):
    """A19."""
    return rounded(R.model_agreement(_stacked(spark, d)[1]), "srcc")


@query("mean_agreement", WITH + f", {A.SCORES}, {_STACKED}, x AS (SELECT a.model || '/' || b.model AS g, a.score AS pred, b.score AS target FROM last a JOIN last b ON a.sample_id = b.sample_id AND a.model < b.model), m AS ({A.ranked_metrics_sql('g', 'x')}) SELECT round(avg(srcc), 6)::DOUBLE AS mean_srcc, 2 * count(*) AS n FROM m")
def mean_agreement(spark, d):
    """The matrix' mean off its diagonal."""
    return rounded(R.mean_agreement(_stacked(spark, d)[1]), "mean_srcc")


@query("average_ranks", "WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, l_quantity AS v FROM lineitem) SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0::DOUBLE AS rank FROM x")
def average_ranks(spark, d):
    """The rank of every row, in three groups of very many ties."""
    x = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))
    return stats.with_average_rank(x, ["g"], "v", "rank").select("l_orderkey", "l_linenumber", F.col("rank").cast("double").alias("rank"))


# ---- aggregates -----------------------------------------------------------------------------------------


@query("scene_groups", WITH + " SELECT sequence_frame, count(*) AS n, arg_min(question_id, ord) AS first_question FROM entries GROUP BY sequence_frame")
def scene_groups(spark, d):
    """A1."""
    e = A.entries(spark, d).withColumn("uav_paths", F.create_map(F.lit("q"), F.col("question_id")))
    return R.scene_groups(e).select("sequence_frame", "n", F.element_at("uav_paths", "q").alias("first_question"))


@query("table_one", WITH + f", p AS (SELECT dataset, count(*) AS pairs, count(DISTINCT sequence_frame) AS refs, count(*) FILTER (distortion IN {UAV_SQL}) AS uav_pairs FROM entries GROUP BY dataset) SELECT coalesce(dataset, 'Total') AS dataset, sum(pairs)::BIGINT AS pairs, sum(refs)::BIGINT AS refs, sum(uav_pairs)::BIGINT AS uav_pairs FROM p GROUP BY ROLLUP (dataset)")
def table_one(spark, d):
    """A14, K11, S20."""
    return R.table_one(A.entries(spark, d))


@query("means_by_level", WITH + " SELECT distortion, level, round(avg(score), 6)::DOUBLE AS mean, count(*) AS n FROM entries GROUP BY GROUPING SETS ((distortion, level), (distortion), ())")
def means_by_level(spark, d):
    """A15, L1."""
    return rounded(R.means_by_level(A.entries(spark, d)), "mean")


@query("error_by_level", WITH + " SELECT level, round(avg(score), 6)::DOUBLE AS mean, round(stddev_pop(score) / sqrt(count(*)), 8)::DOUBLE AS sem FROM entries GROUP BY level")
def error_by_level(spark, d):
    """A16."""
    return rounded(rounded(R.error_by_level(A.entries(spark, d)), "mean"), "sem", digits=8)


@query("pivot_means", WITH + " SELECT subtask_type, " + ", ".join(f"round(avg(score) FILTER (distortion = '{n}'), 6)::DOUBLE AS {n}" for n in DISTORTIONS) + " FROM entries GROUP BY subtask_type")
def pivot_means(spark, d):
    """Absent cells stay null."""
    return rounded(R.pivot_means(A.entries(spark, d), list(DISTORTIONS)), *DISTORTIONS)


@query("report_categories", WITH + f" SELECT {case_of(REPORT_CATEGORY, 'category', chr(39) + 'Other' + chr(39))} AS report_category, round(avg(score), 6)::DOUBLE AS mean, round(stddev_pop(score), 6)::DOUBLE AS std, count(*) AS n FROM entries GROUP BY 1")
def report_categories(spark, d):
    """A20."""
    return rounded(R.report_categories(A.entries(spark, d)), "mean", "std")


@query("question_counts", WITH + " SELECT question_type, dataset, count(*) AS n FROM entries GROUP BY ALL")
def question_counts(spark, d):
    """A21."""
    return A.entries(spark, d).groupBy("question_type", "dataset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dataset")


@query("status_counts", "WITH t AS (SELECT o_orderpriority AS file_path, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'success' ELSE 'failed' END AS status FROM orders) SELECT file_path, count(*) FILTER (status = 'pending') AS pending, 0::BIGINT AS running, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM t GROUP BY file_path")
def status_counts(spark, d):
    """A22, P10."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return R.status_counts(A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("file_path"), status.alias("status")))


@query("prompt_index", WITH + " SELECT sequence_frame AS stem, list(question_id ORDER BY ord) AS prompts FROM entries GROUP BY 1")
def prompt_index(spark, d):
    """A12."""
    return R.prompt_index(A.entries(spark, d).select(F.col("sequence_frame").alias("stem"), "ord", F.col("question_id").alias("prompt")))


@query("last_reference_scores", WITH + " SELECT sequence_frame, arg_max(score, ord) AS score FROM entries GROUP BY 1")
def last_reference_scores(spark, d):
    """A13."""
    return R.last_by_key(A.entries(spark, d), "sequence_frame", "score", "ord")


@query("vqa_run_summary", f"""SELECT count(*) AS n, round(avg(metric1), 6)::DOUBLE AS mean_metric1, round(avg(metric2), 6)::DOUBLE AS mean_metric2, count(*) FILTER (baseline_failed) AS baseline_failures FROM ({ORACLE_SQL["truth_scores"]})""")
def vqa_run_summary(spark, d):
    """The means of both metrics and the failed baselines of a run against a truth."""
    t = text.with_truth(_answers(spark, d))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("metric1"), 6).alias("mean_metric1"), F.round(F.avg("metric2"), 6).alias("mean_metric2"), F.count_if("baseline_failed").alias("baseline_failures"))


@query("vqa_summary", WITH + " SELECT count(*) AS n, round(avg(score), 6)::DOUBLE AS mean_metric1, round(avg(target), 6)::DOUBLE AS mean_metric2, count(*) FILTER (score < 0.01) AS baseline_failures FROM entries")
def vqa_summary(spark, d):
    """A24."""
    return A.entries(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_metric1"), F.round(F.avg("target"), 6).alias("mean_metric2"), F.count_if(F.col("score") < 0.01).alias("baseline_failures"))


@query("list_valued_scores", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6)::DOUBLE AS score FROM embeddings")
def list_valued_scores(spark, d):
    """A26."""
    v = A.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return v.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y) / F.size("x"), 6).alias("score"))


# ---- joins, filters, sets, limits -----------------------------------------------------------------------


@query("expanded_questions", WITH + ", g AS (SELECT DISTINCT dataset, sequence_frame FROM entries), x AS (SELECT *, unnest(" + A.sql_list(list(DISTORTIONS)) + ") AS distortion FROM g) SELECT e.ord, x.distortion, (42 + (('0x' || substr(md5(dataset || '__' || sequence_frame || '__' || x.distortion), 25, 8))::BIGINT & 2147483647)) % 2147483648 AS seed FROM entries e JOIN x USING (dataset, sequence_frame)")
def expanded_questions(spark, d):
    """J4, J5 with F9: groups by the catalogue, then back to the questions."""
    e = A.entries(spark, d)
    groups = R.all_distortions(e.select("dataset", "sequence_frame").distinct())
    groups = groups.withColumn("seed", strings.distortion_seed(F.col("dataset"), F.col("sequence_frame"), F.col("distortion")))
    return R.expand(e.select("ord", "dataset", "sequence_frame"), groups, ["dataset", "sequence_frame"]).select("ord", "distortion", "seed")


@query("prompts_by_suffix", "WITH i AS (SELECT url AS image FROM pages), p AS (SELECT page_id AS ord, substr(url, greatest(1, length(url) - 5 - page_id % 3)) AS stem, 'p' || page_id AS prompt FROM pages) SELECT image, arg_min(prompt, ord) AS prompt FROM (SELECT DISTINCT image FROM i) JOIN p ON ends_with(image, stem) GROUP BY image")
def prompts_by_suffix(spark, d):
    """J3."""
    pages = A.table(spark, d, "pages").select("page_id", "url")
    at = F.greatest(F.lit(1), F.length("url") - 5 - F.col("page_id") % 3).cast("int")
    prompts = pages.select(F.col("page_id").alias("ord"), F.substring(F.col("url"), at, F.length("url")).alias("stem"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("prompt"))
    return R.first_suffix_match(pages.select(F.col("url").alias("image")).distinct(), prompts)


@query("zipped_views", WITH + " SELECT ord, unnest(CASE WHEN uav = 1 THEN ['UAV1'] WHEN uav = 2 THEN ['UAV1', 'UAV2'] ELSE ['UAV1', 'UAV2', 'UAV3'] END) AS view, CASE WHEN view = 'UAV2' THEN '' ELSE 'd' || ord END AS dist FROM entries")
def zipped_views(spark, d):
    """J6, P6."""
    e = A.entries(spark, d)
    views = F.map_from_entries(F.transform(F.reverse(F.sequence(F.lit(1), F.col("uav").cast("int"))), lambda i: F.struct(F.concat(F.lit("UAV"), i.cast("string")), F.lit("r"))))
    dist = F.map_filter(F.transform_values(views, lambda k, v: F.concat(F.lit("d"), F.col("ord").cast("string"))), lambda k, v: k != "UAV2")
    return e.select("ord", F.inline(R.zip_views(views, dist))).select("ord", "view", "dist")


@query("filtered_entries", WITH + f" SELECT ord, subtask_type, distortion FROM entries WHERE subtask_type IN ('object_counting', 'object_matching') AND distortion NOT IN {UAV_SQL}")
def filtered_entries(spark, d):
    """P3, P4."""
    return A.entries(spark, d).where(R.subtask_filter(F.col("subtask_type"), "object_counting, object_matching") & R.distortion_filter(F.col("distortion"), "generic")).select("ord", "subtask_type", "distortion")


@query("benchmark_projection", WITH + " SELECT ord AS sample_id, 'd/' || ord || '.png' AS path, subtask_type AS task, distortion, category, level / 10.0::DOUBLE AS intensity_level, CASE WHEN uav = 2 THEN 0 ELSE score END AS score, 'r' || ord AS ref_id FROM entries WHERE uav <> 3")
def benchmark_projection(spark, d):
    """P1, P2, P16."""
    e, c = A.entries(spark, d), F.col
    path = lambda p, s: F.concat(F.lit(p), c("ord").cast("string"), F.lit(s))
    some = c("uav") != 3
    samples = e.select(
        c("ord").alias("sample_id"), F.when(some, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), path("raw/r", ".jpg"))).otherwise(F.create_map().cast("map<string,string>")).alias("uav_paths"), F.create_map(F.lit("a"), path("d/", ".png")).alias("distorted_uav_paths"),
        "subtask_type", F.struct(c("distortion").alias("type"), c("category"), (c("level") / 10).alias("intensity")).alias("distortion_info"), F.when(c("uav") != 2, c("score")).alias("cognitive_score"))
    return R.benchmark_samples(samples).select("sample_id", "path", "task", "distortion", "category", "intensity_level", "score", "ref_id")


@query("single_view_questions", WITH + " SELECT ord FROM entries WHERE NOT (uav <> 2 AND level > 4) AND uav <> 3")
def single_view_questions(spark, d):
    """P7."""
    c = F.col
    options = F.create_map(F.lit("A"), F.lit("none"), F.lit("B"), F.when(c("level") > 4, "only UAV2").otherwise("no view"))
    view = F.concat(F.lit("UAV"), c("uav").cast("string"))
    paths = F.create_map(F.lit("UAV1"), F.lit("p"), F.lit("UAV2"), F.lit("q"))
    return A.entries(spark, d).where(R.single_view_question(options, view, paths)).select("ord")


@query("paths_and_blanks", "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN NULL ELSE 'a/' || page_id END AS path, page_id % 4 = 0 AS blank FROM pages")
def paths_and_blanks(spark, d):
    """P8, P9, P12."""
    p = A.table(spark, d, "pages").select("page_id")
    i = F.col("page_id").cast("string")
    p = p.withColumn("_p", F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/../../b"), i)).otherwise(F.concat(F.lit("//a\\"), i))).withColumn("_x", F.when(F.col("page_id") % 2 == 1, "t")).withColumn("_y", F.when(F.col("page_id") % 4 == 0, "").otherwise("t"))
    return p.select("page_id", R.contained_path(F.col("_p")).alias("path"), R.empty_record("_x", "_y").alias("blank"))


@query("split_lookup", WITH + " SELECT sequence_frame AS image, CASE WHEN bool_or(split = 'test') THEN 'test' ELSE 'train' END AS split, bool_or(split = 'test') AND bool_or(split = 'train') AS overlap FROM entries GROUP BY 1")
def split_lookup(spark, d):
    """O1, O4, J12."""
    return R.split_lookup(A.entries(spark, d).select(F.col("sequence_frame").alias("image"), "split"))


@query("set_differences", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 100 AS k FROM orders) b ON a.k = b.k")
def set_differences(spark, d):
    """One full outer join of the distinct keys instead of three set operations; the orders' keys are moved on by 100, so that both sides lack some."""
    a = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = A.table(spark, d, "orders").select((F.col("o_custkey") + 100).alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "missing").otherwise("extra").alias("side"))


@query("skip_existing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def skip_existing(spark, d):
    """The anti join of a resumed run."""
    return A.table(spark, d, "orders").select("o_orderkey").join(A.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("output_violations", WITH + ", b AS (SELECT dataset AS source_file, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS k, ord FROM entries), a AS (SELECT source_file, k, CASE WHEN k % 50 = 7 THEN -1 ELSE ord END AS ord FROM b WHERE k % 40 <> 3) SELECT source_file, k AS ord, CASE WHEN a.ord IS NULL THEN 'missing' ELSE 'order' END AS fault FROM b LEFT JOIN a USING (source_file, k) WHERE a.ord IS NULL OR a.ord <> b.ord")
def output_violations(spark, d):
    """J10, C6, O3."""
    from pyspark.sql import Window

    b = A.entries(spark, d).select(F.col("dataset").alias("source_file"), F.col("ord").alias("sample_id"), (F.row_number().over(Window.partitionBy("dataset").orderBy("ord")) - 1).cast("long").alias("ord"))
    a = b.where("ord % 40 <> 3").withColumn("sample_id", F.when(F.col("ord") % 50 == 7, F.lit(-1)).otherwise(F.col("sample_id")))
    return R.compare_outputs(b, a).select("source_file", "ord", "fault")


_OUTPUTS = "b AS (SELECT dataset || '-' || level AS source_file, ord, CASE WHEN uav = 3 THEN NULL ELSE ord END AS id FROM entries), a AS (SELECT source_file, ord, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 1999 = 5 THEN -1 ELSE id END AS id FROM b WHERE ord % 4001 <> 3)"


def _outputs(spark, d):
    """Records of many files, some without ids, and an output of them that lost some records and exchanged others."""
    b = A.entries(spark, d).select(F.concat_ws("-", "dataset", "level").alias("source_file"), "ord", F.when(F.col("uav") != 3, F.col("ord")).alias("sample_id"))
    a = b.where("ord % 4001 <> 3").withColumn("sample_id", F.when(F.col("ord") % 7 == 0, F.lit(None)).when(F.col("ord") % 1999 == 5, F.lit(-1)).otherwise(F.col("sample_id")))
    return b, a


@query("file_faults", WITH + f""", {_OUTPUTS}, s AS (SELECT source_file, count(b.ord) AS n_in, count(a.ord) AS n_out, min(b.ord) FILTER (a.id <> b.id) AS place FROM b LEFT JOIN a USING (source_file, ord) GROUP BY 1)
SELECT source_file, CASE WHEN n_out = 0 THEN 'missing' WHEN n_in <> n_out THEN 'count' ELSE 'order' END AS fault, CASE WHEN n_in = n_out THEN place END AS "at" FROM s WHERE n_in <> n_out OR place IS NOT NULL""")
def file_faults(spark, d):
    """What is wrong with each output file, with ids missing on either side."""
    return R.file_faults(*_outputs(spark, d))


@query("output_verdict", WITH + f""", {_OUTPUTS}, s AS (SELECT source_file, count(b.ord) AS n_in, count(a.ord) AS n_out, min(b.ord) FILTER (a.id <> b.id) AS place FROM b LEFT JOIN a USING (source_file, ord) GROUP BY 1)
SELECT count(*) FILTER (n_in <> n_out OR place IS NOT NULL) = 0 AS valid, count(*) FILTER (n_in <> n_out OR place IS NOT NULL) AS errors, count(*) FILTER (n_out > 0) AS file_count, sum(n_out)::BIGINT AS total_records FROM s""")
def output_verdict(spark, d):
    """The one row that says whether a run's output may be taken."""
    return R.output_verdict(*_outputs(spark, d))


@query("affected_chunks", WITH + " SELECT DISTINCT dataset AS source_file, CAST(ord // 256 AS INTEGER) AS chunk_id FROM entries WHERE score < 0.02")
def affected_chunks(spark, d):
    """J11, C1, C10."""
    return R.affected_chunks(A.entries(spark, d).where("score < 0.02").select(F.col("dataset").alias("source_file"), "ord"), 256)


@query("entry_budget", WITH + " SELECT dataset, ord FROM entries ORDER BY dataset, ord LIMIT 300")
def entry_budget(spark, d):
    """L2, L4: the budget is the feature."""
    return R.first_rows(A.entries(spark, d).select("dataset", "ord"), 300, "dataset", "ord")


@query("annotation_cap", WITH + " SELECT source_file, ord FROM (SELECT dataset AS source_file, ord, uav, count(*) FILTER (uav < 3) OVER (PARTITION BY dataset ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM entries) WHERE uav < 3 AND k <= 100")
def annotation_cap(spark, d):
    """L3: the cap is the feature."""
    views = F.when(F.col("uav") < 3, F.create_map(F.lit("a"), F.lit("b"))).otherwise(F.create_map().cast("map<string,string>"))
    return R.scored_within_cap(A.entries(spark, d).select(F.col("dataset").alias("source_file"), "ord", views.alias("uav_paths")), 100).select("source_file", "ord")


@query("best_checkpoints", WITH + " SELECT dataset, arg_max(ord, struct_pack(s := score, o := ord)) AS best FROM entries GROUP BY dataset")
def best_checkpoints(spark, d):
    """L5."""
    return A.entries(spark, d).groupBy("dataset").agg(F.max_by("ord", F.struct("score", "ord")).alias("best"))


@query("list_mle_loss", WITH + f", {A.PREDS} SELECT distortion, round(sum(t) / count(*), 6)::DOUBLE AS loss FROM (SELECT distortion, ln(sum(exp(pred)) OVER (PARTITION BY distortion ORDER BY target DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - pred AS t FROM preds) GROUP BY distortion HAVING count(*) >= 3")
def list_mle_loss(spark, d):
    """W2, W3, U16."""
    return rounded(R.list_mle(A.preds(A.entries(spark, d))), "loss")


@query("cross_task_loss", WITH + f", {A.SCORES}, {_STACKED}, p AS (SELECT a.sample_id, avg(pow(a.score - b.score, 2)) AS v FROM last a JOIN last b ON a.sample_id = b.sample_id AND a.model < b.model GROUP BY 1) SELECT round(-avg(v), 6)::DOUBLE AS loss FROM p")
def cross_task_loss(spark, d):
    """U16."""
    last = _stacked(spark, d)[1]
    return rounded(R.cross_task_loss(last.select(F.col("sample_id").alias("id"), F.col("score").alias("pred"))), "loss")


@query("constant_scorer", WITH + " SELECT ord AS sample_id, 0.5::DOUBLE AS score FROM entries")
def constant_scorer(spark, d):
    """The map-batches scorer with a constant model."""
    from ..operators.scoring import ConstantScorer, score_tensors

    return score_tensors(A.entries(spark, d).select(F.col("ord").alias("sample_id"), F.col("score").cast("double").alias("x")), ConstantScorer(0.5), {"x": None}).select("sample_id", "score")


_LOSSES = "mse AS (SELECT distortion, avg((pred - target) * (pred - target)) AS mse FROM preds GROUP BY 1), mle AS (SELECT distortion, sum(t) / count(*) AS mle FROM (SELECT distortion, ln(sum(exp(pred)) OVER (PARTITION BY distortion ORDER BY target DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - pred AS t FROM preds) GROUP BY distortion HAVING count(*) >= 3)"


@query("total_loss", WITH + f", {A.SCORES}, {_STACKED}, {A.PREDS}, {_LOSSES}, p AS (SELECT a.sample_id, avg(pow(a.score - b.score, 2)) AS v FROM last a JOIN last b ON a.sample_id = b.sample_id AND a.model < b.model GROUP BY 1), ct AS (SELECT -avg(v) AS ct FROM p) SELECT distortion, round(mse, 6)::DOUBLE AS mse, round(mle, 6)::DOUBLE AS list_mle, round(ct, 6)::DOUBLE AS cross_task, round(mse + 0.3 * coalesce(mle, 0) + 0.1 * ct, 6)::DOUBLE AS loss FROM mse LEFT JOIN mle USING (distortion), ct")
def total_loss(spark, d):
    """U16: the weighted sum of the three terms."""
    e, last = _stacked(spark, d)
    return rounded(R.total_loss(A.preds(e), last.select(F.col("sample_id").alias("id"), F.col("score").alias("pred"))), "mse", "list_mle", "cross_task", "loss")


# ---- tasks, splits, policies ----------------------------------------------------------------------------

_TASKS = "t AS (SELECT o_orderkey AS task_id, o_orderpriority AS file_path, CAST(o_custkey AS INTEGER) AS chunk_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'success' ELSE 'running' END AS status FROM orders)"


def _tasks(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "success").otherwise("running")
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("file_path"), F.col("o_custkey").cast("int").alias("chunk_id"), status.alias("status"), F.lit(0).alias("retry_count"))


@query("pending_tasks", f"WITH {_TASKS} SELECT task_id, status FROM t WHERE status IN ('pending', 'failed', 'running')")
def pending_tasks(spark, d):
    """P10: what is to be done after a crash."""
    return R.pending_tasks(_tasks(spark, d), after_crash=True).select("task_id", "status")


@query("status_changes", f"""WITH {_TASKS}, c AS (SELECT l_orderkey AS task_id, l_linenumber AS moment, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'running' ELSE 'success' END AS status FROM lineitem),
l AS (SELECT task_id, arg_max(status, (moment, status)) AS status, count(*) FILTER (status = 'failed') AS fails FROM c GROUP BY 1) SELECT task_id, coalesce(l.status, t.status) AS status, coalesce(fails, 0)::INTEGER AS retry_count FROM t LEFT JOIN l USING (task_id)""")
def status_changes(spark, d):
    """The last state and the retries of every task."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "running").otherwise("success")
    changes = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.struct("l_linenumber", status.alias("status")).alias("at"), status.alias("status"))
    return R.status_changes(_tasks(spark, d), changes).select("task_id", "status", "retry_count")


@query("split_roles", WITH + " SELECT ord, 'train' AS role FROM entries WHERE split = 'train' UNION ALL SELECT ord, unnest(['validate', 'test']) FROM entries WHERE split = 'test'")
def split_roles(spark, d):
    """The test split validates and tests."""
    return R.split_rows(A.entries(spark, d), "fit").select("ord", "role")


@query("unequal_lists", WITH + " SELECT ord, least(uav, level // 2)::INTEGER AS truncated, CASE WHEN uav = level // 2 THEN uav::INTEGER END AS whole FROM entries")
def unequal_lists(spark, d):
    """Lists of two lengths, cut to the shorter one or refused."""
    e = A.entries(spark, d)
    a, b = F.sequence(F.lit(1), F.col("uav").cast("int")), F.sequence(F.lit(1), (F.col("level") / 2).cast("int"))
    return e.select("ord", F.size(R.paired(a, b)).alias("truncated"), F.when(R.paired(a, b, "null").isNotNull(), F.size(R.paired(a, b, "null"))).alias("whole"))


@query("training_rows", WITH + f" SELECT ord, CASE WHEN uav = 2 THEN 0 ELSE score END AS score, CAST({case_of({SUBTASKS[c]: i for i, c in enumerate(A.CODES)}, 'subtask_type', '0')} AS INTEGER) AS task_id, CASE WHEN uav = 3 THEN 'unknown' ELSE distortion END AS distortion, CASE WHEN uav = 3 THEN 0 ELSE level / 10.0::DOUBLE END AS intensity FROM entries")
def training_rows(spark, d):
    """Defaults of missing scores and distortions."""
    c = F.col
    e = A.entries(spark, d).select("ord", "subtask_type", F.when(c("uav") != 2, c("score")).alias("cognitive_score"), F.when(c("uav") != 3, F.struct(c("distortion").alias("type"), (c("level") / 10).alias("intensity"))).alias("distortion_info"))
    return R.training_rows(e).select("ord", "score", "task_id", "distortion", "intensity")


@query("sample_id_parts", WITH + " SELECT ord, dataset, split, replace(sequence_frame, '/', '_') AS frame, question_id, distortion, level / 10.0::DOUBLE AS intensity FROM entries")
def sample_id_parts(spark, d):
    """Sample ids taken apart again."""
    c = F.col
    key = strings.sample_id(c("dataset"), c("sequence_frame"), c("distortion"), c("level"), c("split"), c("question_id"))
    return A.entries(spark, d).select("ord", strings.sample_id_parts(key).alias("p")).select("ord", "p.*")


@query("model_names", "SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'other/thing' END AS model FROM embeddings")
def model_names(spark, d):
    """aliases, short names, hub ids, other hub ids, and names of nothing."""
    names = F.array(*map(F.lit, ["tiny", "small", "org/large-7b", "other/thing", "nothing"]))
    v = A.table(spark, d, "embeddings").select("vec_id", F.element_at(names, (F.col("vec_id") % 5 + 1).cast("int")).alias("name"))
    return v.select("vec_id", strings.model_name(F.col("name"), {"tiny": "small"}, {"small": "org/small-1b", "large": "org/large-7b"}).alias("model"))


# ---- files ----------------------------------------------------------------------------------------------

_FILES = "f AS (SELECT 'train/' || dataset || '_VQA_' || split || '.json' AS name, row_number() OVER (PARTITION BY dataset, split ORDER BY ord) - 1 AS place, * FROM entries)"
_RECORD = "sample_id string, question string, uav_paths map<string,string>, cognitive_score double"


def _written(spark, d) -> str:
    """entries as JSON arrays, a file for each dataset and split, in the shared folder."""
    from ..session import run_folder
    from ..sources import sinks

    root = run_folder(spark, "json")
    e, c = A.entries(spark, d), F.col
    rows = e.select(F.concat(F.lit("train/"), "dataset", F.lit("_VQA_"), "split", F.lit(".json")).alias("source_file"), c("ord").alias("place"), c("ord").cast("string").alias("sample_id"), c("question_id").alias("question"), F.when(c("uav") != 3, F.create_map(F.lit("UAV1"), c("sequence_frame"))).alias("uav_paths"), F.when(c("uav") != 2, c("score")).alias("cognitive_score"))
    sinks.write_files(rows, root, order="place", drop=("source_file", "place"))
    return root


@query("json_arrays", WITH + f", {_FILES} SELECT name, place::INTEGER AS ord, ord AS sample_id, question_id AS question, CASE WHEN uav <> 3 THEN sequence_frame END AS view, CASE WHEN uav <> 2 THEN score END AS cognitive_score FROM f")
def json_arrays(spark, d):
    """Entries written as JSON arrays in one job, and read back in order."""
    from ..sources import json_arrays as J

    rows = J.read_arrays(spark, f"{_written(spark, d)}/train", _RECORD)
    return rows.select(F.concat(F.lit("train/"), F.substring_index("source_file", "/", -1)).alias("name"), "ord", F.col("sample_id").cast("long").alias("sample_id"), "question", F.col("uav_paths")["UAV1"].alias("view"), "cognitive_score")


@query("json_files", WITH + f", {_FILES} SELECT name, count(*)::INTEGER AS records, true AS valid FROM f GROUP BY name")
def json_files(spark, d):
    """The files with their counts and whether they are arrays."""
    from ..sources import json_arrays as J

    root = _written(spark, d)
    counted = J.file_counts(spark, root).join(J.validate_files(spark, f"{root}/train").select("file_path", "valid"), "file_path")
    return counted.select(F.concat(F.lit("train/"), F.substring_index("file_path", "/", -1)).alias("name"), "records", "valid")


@query("json_chunk", WITH + f", {_FILES} SELECT place::INTEGER AS ord, ord AS sample_id FROM f WHERE name = 'train/Sim3_VQA_train.json' AND place >= 10 AND place < 50")
def json_chunk(spark, d):
    """The half-open chunk of one file is the feature."""
    from ..sources import json_arrays as J

    rows = J.read_chunk(spark, f"{_written(spark, d)}/train/Sim3_VQA_train.json", 10, 50, _RECORD)
    return rows.select("ord", F.col("sample_id").cast("long").alias("sample_id"))


@query("first_prompts_by_file_order", WITH + f", {_FILES} SELECT sequence_frame AS stem, arg_min(question_id, (CASE split WHEN 'train' THEN 0 ELSE 1 END, name, place)) AS prompt FROM f GROUP BY 1")
def first_prompts_by_file_order(spark, d):
    """Index files are read training ones first, then by name; the first prompt of a stem counts."""
    from ..sources import json_arrays as J

    rows = J.in_file_order(J.read_arrays(spark, f"{_written(spark, d)}/train", "question string, sample_id string"))
    stems = A.entries(spark, d).select(F.col("ord").cast("string").alias("sample_id"), "sequence_frame")
    return rows.join(stems, "sample_id").groupBy(F.col("sequence_frame").alias("stem")).agg(F.min_by("question", "place").alias("prompt"))


@query("annotated_scores", WITH + " SELECT ord AS sample_id, 0.25::DOUBLE AS cognitive_score, 'm0' AS models FROM entries")
def annotated_scores(spark, d):
    """Scored through the progress table, in two commits with a resume between them."""
    from ..operators import scoring
    from ..session import run_folder
    from ..sources.sinks import Progress

    e = A.entries(spark, d).select(F.col("ord").cast("string").alias("sample_id"), F.lit(None).cast("map<string,double>").alias("vlm_scores"), F.lit(None).cast("double").alias("cognitive_score"), "split")
    progress = Progress(spark, run_folder(spark, "progress"))
    for some in (e.where("split = 'test'"), e):
        scoring.annotate(some, scoring.ConstantScorer(0.25), "m0", progress)
    return scoring.annotated_means(e, progress).select(F.col("sample_id").cast("long").alias("sample_id"), "cognitive_score", F.array_join(F.map_keys("vlm_scores"), ",").alias("models"))


@query("resumed_scores", WITH + """, w AS (SELECT *, len(list_filter(string_split(question_type, ' '), lambda x: x <> '')) AS words FROM entries),
m AS (SELECT ord AS sample_id, CASE WHEN uav <> 3 THEN words / CASE WHEN level = 2 THEN 4.0::DOUBLE ELSE 10.0::DOUBLE END END AS m0, CASE WHEN uav <> 3 THEN words / 5.0::DOUBLE END AS m1, uav = 3 AS failed FROM w)
SELECT sample_id, m0, m1, round_even((m0 + m1) / 2, 6)::DOUBLE AS cognitive_score, CASE WHEN failed THEN 2 ELSE 0 END AS models_failed FROM m""")
def resumed_scores(spark, d):
    """Two models through the progress log; questions that are missing fail, a second run finds the rest, and samples of one level are reset and scored anew."""
    from ..operators import scoring
    from ..session import run_folder
    from ..sources.sinks import Progress

    c = F.col
    e = A.entries(spark, d).select(c("ord").cast("string").alias("sample_id"), F.lit(None).cast("map<string,double>").alias("vlm_scores"), F.lit(None).cast("double").alias("cognitive_score"), F.when(c("uav") != 3, c("question_type")).alias("question"), "split", "level")
    progress = Progress(spark, run_folder(spark, "progress"))
    for model, per in (("m0", 10), ("m1", 5)):
        for some in (e.where("split = 'test'"), e):
            scoring.annotate(some, scoring.WordCounts(per), model, progress)
    progress.reset(e.where("level = 2"), "m0")
    scoring.annotate(e, scoring.WordCounts(4), "m0", progress)
    failed = progress.rows().groupBy("sample_id").agg(F.count_if(c("status") == "failed").cast("int").alias("models_failed"))
    means = scoring.annotated_means(e, progress).join(failed, "sample_id")
    return means.select(c("sample_id").cast("long").alias("sample_id"), c("vlm_scores")["m0"].alias("m0"), c("vlm_scores")["m1"].alias("m1"), "cognitive_score", "models_failed")


@query("run_progress", WITH + """, n AS (SELECT dataset, count(*) AS rows, count(*) FILTER (uav = 2) AS errors FROM entries GROUP BY 1)
SELECT row_number() OVER (ORDER BY dataset) - 1 AS step, rows, errors, (sum(rows) OVER (ORDER BY dataset))::BIGINT AS done, (sum(rows) OVER ())::BIGINT AS total, round(100.0 * sum(rows) OVER (ORDER BY dataset) / sum(rows) OVER (), 6)::DOUBLE AS percent, true AS timed FROM n""")
def run_progress(spark, d):
    """The figures that a run leaves as it goes, one dataset a step."""
    from ..session import run_folder
    from ..streaming.observed import Run, RunTable

    e = A.entries(spark, d).select("dataset", F.when(F.col("uav") == 2, F.lit("no view")).alias("error"))
    sizes = {r.dataset: r["count"] for r in e.groupBy("dataset").count().collect()}  # a few datasets
    table = RunTable(spark, run_folder(spark, "figures"))
    run = Run(table, "entries", sum(sizes.values()))
    for name in sorted(sizes):
        run.step(e.where(F.col("dataset") == name), lambda df: df.write.format("noop").mode("overwrite").save())
    timed = (F.col("seconds") > 0) & (F.col("rate") > 0) & (F.col("eta") >= 0)
    return table.rows().select("step", "rows", "errors", "done", "total", F.round("percent", 6).alias("percent"), timed.alias("timed"))


@query("reference_images", WITH + " SELECT DISTINCT dataset AS folder, replace(sequence_frame, '/', '_') || '.png' AS name, 'png' AS extension FROM entries WHERE distortion = 'white_noise' AND dataset = 'Sim3'")
def reference_images(spark, d):
    """Images written from rows and found by an adapter through the data source, of one folder; no other is opened."""
    from ..session import run_folder
    from ..sources.image_files import write_pngs
    from ..sources.image_listing import reference_images

    root = run_folder(spark, "images")
    frame = F.concat(F.regexp_replace("sequence_frame", "/", "_"), F.lit(".png"))
    kept = F.when(F.col("distortion") == "white_noise", F.concat_ws("/", "dataset", frame)).when(F.col("distortion") == "motion_blur", F.concat_ws("/", "dataset", F.lit("distorted"), frame))
    e = A.entries(spark, d).select(kept.alias("name")).where("name IS NOT NULL").distinct()
    pixel = F.unhex(F.substring(F.md5(F.col("name").cast("binary")), 1, 6))
    failed = write_pngs(e.select("name", pixel.alias("image"), F.lit(1).alias("h"), F.lit(1).alias("w")), root).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} images could not be written")
    return reference_images(spark, root, "multi_drone").where("folder = 'Sim3'").select("folder", "name", "extension")


@query("picked_intensities", None)
def picked_intensities(spark, d):
    """Mersenne-Twister choices, in Arrow batches (no SQL form)."""
    from ..functions.images import pick_intensity

    e = A.entries(spark, d).select("dataset", "sequence_frame", "distortion").distinct()
    return e.withColumn("intensity", pick_intensity(F.concat_ws("__", "dataset", "sequence_frame", "distortion")))


from . import image_queries  # noqa: E402, F401  further queries, which register themselves
