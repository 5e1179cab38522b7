"""Operator 3, chat formatting with typed content parts (DataFrame functions only).

A turn's content is an ordered list of parts: text, image, audio or document.  The visitor turns each part
into text: an escaped text, or a placeholder ``<|part:type|>`` whose attachment (type, reference, expanded tokens)
is recorded in the same order.  A turn is ``<|turn|>role<|text|>content<|end|>``.  Control strings inside texts lose
their first character to an entity, and types their bars, too, so that no text or type can open or close anything;
``read_back`` gives texts and typed parts back.  The loss mask covers the text parts of assistant turns.

Defined results: null texts and roles are empty; an unknown part type, whatever its name, counts as an attachment of
0 tokens; text parts that stand together are read back as one, empty ones not at all; a null part list is an empty turn; turns are ordered by turn (null first), ties by role and content; repeated
rows are repeated turns; rows without conv_id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END, OPEN, CLOSE = "<|turn|>", "<|text|>", "<|end|>", "<|part:", "|>"
#: First characters of what may not stand in a text as it is: this template's marks and those of common chat formats.
ANGLE, SQUARE = r"<(?=\||/?s>|<?/?SYS>>)", r"\[(?=/?INST\])"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a document page.
EXPANDED = {"image": 256, "audio": 25, "document": 512}
LEARNED = "assistant"
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    text = F.regexp_replace(F.regexp_replace(text, SQUARE, "&lsqb;"), ANGLE, "&lt;")
    return F.replace(text, F.lit("\0"), F.lit("&nul;"))


def unescaped(text: Column) -> Column:
    for mark, char in (("&nul;", "\0"), ("&lt;", "<"), ("&lsqb;", "["), ("&vert;", "|"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(kind), F.lit("|"), F.lit("&vert;")), F.lit(CLOSE))


def parts_of(shown: Column) -> Column:
    """type (text or an attachment's) and text of the parts of a turn's formatted content."""
    kind = "struct<type:string,text:string>"
    part = lambda t, x: F.struct(t.alias("type"), x.alias("text")).cast(kind)
    text = lambda x: part(F.lit("text"), unescaped(x))
    after = lambda x: F.substring(x, F.instr(x, CLOSE) + len(CLOSE), F.length(x))
    pieces = F.transform(F.split(shown, r"<\|part:", -1), lambda x, i: F.when(i == 0, F.array(text(x))).otherwise(F.array(part(unescaped(F.substring(x, F.lit(1), F.instr(x, CLOSE) - 1)), F.lit(None)), text(after(x)))))
    return F.filter(F.flatten(pieces), lambda p: p["text"].isNull() | (p["text"] != ""))


def tokens_of(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in EXPANDED.items():
        per = F.when(part["type"] == kind, F.lit(n)).otherwise(per)
    return (per * F.coalesce(part["units"], F.lit(1))).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Plain turns as turns with one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("content"))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in characters), attachments, expanded_tokens.

    ``turns``: conv_id, turn, role, content (array of ``PART``).
    """
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    pieces = F.transform(content, lambda p: F.struct(is_text(p).alias("learn"), F.when(is_text(p), escaped(p["text"])).otherwise(placeholder(p["type"])).alias("shown")))
    attached = F.transform(F.filter(content, lambda p: ~is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role), F.lit(TEXT))
    rows = turns.select("conv_id", "turn", (role == LEARNED).alias("_learn"), head.alias("_head"), pieces.alias("_pieces"), attached.alias("_attached"))
    rows = rows.withColumn("_shown", F.array_join(F.transform("_pieces", lambda x: x["shown"]), ""))
    # where the text parts of a learned turn stand in its block
    walked = F.aggregate(
        "_pieces",
        F.struct(F.length("_head").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct((s["at"] + F.length(x["shown"])).alias("at"), F.when(x["learn"], F.array_append(s["spans"], F.struct(s["at"].alias("start"), F.length(x["shown"]).cast("long").alias("length")))).otherwise(s["spans"]).alias("spans")),
    )
    rows = rows.withColumn("_spans", F.when(F.col("_learn"), walked["spans"]).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))).drop("_pieces")
    order = Window.partitionBy("conv_id").orderBy("turn", "_head", "_shown", F.to_json("_attached"))
    block = F.concat("_head", "_shown", F.lit(END))
    before = F.coalesce(F.sum(F.length(block)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_at", before).withColumn("_k", F.row_number().over(order))
    spans = F.transform("_spans", lambda x: F.struct((F.col("_at") + x["start"]).alias("start"), x["length"].alias("length")))
    turn = F.struct("_k", block.alias("block"), spans.alias("spans"), F.col("_attached").alias("attached"))
    all_ = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return all_.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["block"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text, parts) and the loss texts, from the formatted text and its spans alone.

    The k-th part of a conversation that is no text is its k-th attachment; ``text`` shows it by its placeholder.
    """
    pieces = F.split("formatted", r"<\|end\|>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p))
    halves = F.transform(pieces, lambda p: F.split(body(p), r"<\|text\|>", 2))
    turns = F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text"), parts_of(h[1]).alias("parts")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)


def op3(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    out = read_back(chat_format(text_parts(rows)))
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same for DuckDB; turn order by (turn, role, text) is the operator's where turns are numbered.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(replace(text, '&', '&amp;'), chr(0), '&nul;'),
    '\[(/?INST\])', '&lsqb;\1', 'g'), '<(\||/?s>)', '&lt;\1', 'g') AS half FROM t),
f AS (SELECT *, regexp_replace(regexp_replace(half, '<<(/?SYS>>)', '&lt;&lt;\1', 'g'), '<(/?SYS>>)', '&lt;\1', 'g') AS shown FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '')) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(shown) + 23)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
