"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role share one block; pieces are joined in order.

Template, one block per run of equal roles::

    <|start|>ROLE\\nTEXT<|turn|>TEXT<|end|>\\n

Texts and roles are escaped: ``&`` becomes ``&amp;``, ``<`` ``&lt;``, ``[``
``&lsqb;`` and, in roles, a line feed ``&nl;``.  Every control string of the
usual templates begins with ``<`` or ``[``, so none can stand in an escaped
text, and unescaping in the opposite order gives the text back.

``segments`` cuts the formatted text into pieces with a loss flag: each
assistant text is one flagged piece, everything else (headers, marks, the
texts of others) is not flagged.

Defined cases: null text and null role are empty; equal turn numbers are
ordered by role, then text, nulls first; null conv_id is one conversation;
repeated rows are turns of their own; empty texts keep their turn; an empty
table gives no rows; other columns are not read.  Time is linear in the text
of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, TURN, END = "<|start|>", "<|turn|>", "<|end|>\n"
#: replaced in this order, and taken back in the opposite one (fixed values)
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(c: Column, more: tuple = ()) -> Column:
    for plain, mark in (*ESCAPES, *more):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescape(c: Column, more: tuple = ()) -> Column:
    for plain, mark in reversed((*ESCAPES, *more)):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


ROLE_ESCAPES = (("\n", "&nl;"),)


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) per conversation of (conv_id, turn, role, text)."""
    collected = (turns.select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"),
                                                  F.col("text").cast("string").alias("text")).alias("t"))
                 .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    plain = collected.select("conv_id", F.transform("turns", lambda t: F.struct(
        escape(F.coalesce(t["role"], F.lit("")), ROLE_ESCAPES).alias("role"),
        escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
        (F.coalesce(t["role"], F.lit("")) == trained).alias("loss"))).alias("turns"))
    # the role before and after each turn; null at the ends
    none = F.array(F.lit(None).cast("string"))
    roles = plain.select("conv_id", "turns", F.concat(none, F.transform("turns", lambda t: t["role"]), none).alias("roles"))
    pieces = roles.select("conv_id", F.flatten(F.transform("turns", lambda t, i: F.array(
        F.struct(F.when(F.get("roles", i).eqNullSafe(t["role"]), F.lit(TURN))
                 .otherwise(F.concat(F.lit(START), t["role"], F.lit("\n"))).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["text"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.when(F.get("roles", i + 2).eqNullSafe(t["role"]), F.lit(""))
                 .otherwise(F.lit(END)).alias("text"), F.lit(False).alias("loss"))))).alias("segments"))
    return pieces.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                         F.filter("segments", lambda s: s["loss"] | (s["text"] != "")).alias("segments"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) read back from the formatted text."""
    blocks = formatted.select("*", F.slice(F.split("formatted", r"<\|end\|>\n", -1), 1,
                                           F.size(F.split("formatted", r"<\|end\|>\n", -1)) - 1).alias("blocks"))

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.substring(body, F.length(role) + 2, F.length(body))
        return F.transform(F.split(texts, r"<\|turn\|>", -1), lambda x: F.struct(
            unescape(role, ROLE_ESCAPES).alias("role"), unescape(x).alias("text")))

    return blocks.select("*", F.flatten(F.transform("blocks", turns)).alias("turns")).drop("blocks")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-1) that says control strings; digests read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = read_chats(format_chats(rows.union(extra)))
    loss = back.withColumn("loss_text", F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM rows
), around AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY k) AS next
  FROM numbered
), sized AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS t,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS r
  FROM around
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t) + CASE WHEN prev IS NOT DISTINCT FROM role THEN 8 ELSE 10 + length(r) END
    + CASE WHEN next IS NOT DISTINCT FROM role THEN 0 ELSE 8 END) AS bigint) AS formatted_chars
FROM sized GROUP BY conv_id
"""
