"""Chat formatting by relational expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block. The template is

    <|role:ROLE|>\\n TEXT (<|sep|> TEXT)* <|end|>\\n

(without the blanks). Inside texts every ``<``, any backslashes, ``|`` gets one
more backslash, so no text can hold a control string and the change can be
taken back. The result keeps the segments it is built of: their concatenation
is the formatted string, and ``loss`` marks the segments to be learnt.

Nulls: a null text or role is empty, a null turn sorts first, rows of a null
conv_id form one conversation. Turns with equal numbers are ordered by role,
then by escaped text; repeated rows stay. No rows, no conversations. A
conversation is one output value, and so is bounded by what a string holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, SEP, END = "<|role:", "|>\n", "<|sep|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """No ``<|`` is left in the result; ``unescape`` is its inverse."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("|"), F.lit("\\p"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\p"), F.lit("|")), F.lit("\\e"), F.lit("\\"))


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Per conv_id: ``formatted`` and ``segments`` (array of text, loss).

    ``turns`` has conv_id, turn, role, text. Texts of the role ``learn`` are
    under the loss mask; markers never are.
    """
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), escape(F.coalesce("text", empty)).alias("text"))
    # the sorted array is a column of its own, so the lambdas below refer to it and don't sort again
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def segments(x: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        opening = F.concat(F.when(i > 0, F.lit(END)).otherwise(empty), F.lit(OPEN), _escape_role(x["role"]), F.lit(ROLE_END))
        mark = F.when((i > 0) & (before["role"] == x["role"]), F.lit(SEP)).otherwise(opening)
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")),
                       F.struct(x["text"].alias("text"), (x["role"] == learn).alias("loss")))

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    built = sorted_.select("conv_id", F.concat(F.flatten(F.transform("turns", segments)), closing).alias("segments"))
    return built.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        "segments")


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Read ``formatted`` back: adds ``blocks`` (array of role and texts) and ``turns`` (array of role, text)."""
    def block(b: Column) -> Column:
        at = F.locate(ROLE_END, b)
        return F.struct(_unescape_role(F.substring(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        F.transform(F.split(F.substring(b, at + len(ROLE_END), F.length(b)), r"<\|sep\|>", -1),
                                    unescape).alias("texts"))

    pieces = formatted.withColumn("_pieces", F.split("formatted", r"<\|end\|>\n", -1))
    parsed = pieces.withColumn("blocks", F.transform(
        F.slice("_pieces", F.lit(1), F.size("_pieces") - 1), block)).drop("_pieces")
    return parsed.withColumn("turns", F.flatten(F.transform(
        "blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text"))))))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, and n_blocks (turns after merging)."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(tricky).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    read = parse_formatted(format_conversations(given.unionByName(added)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = read.withColumns({"_lines": lines, "_learnt": learnt})
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("_lines", 256).alias("turns_sha256"),
        F.char_length("_learnt").cast("long").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("blocks").cast("long").alias("n_blocks"))


OP6_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS esc,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text) AS prev,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text) AS k
  FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       (sum(length(esc) + CASE WHEN k > 1 AND prev = role THEN 7
                               ELSE 10 + length(replace(replace(role, '\', '\e'), '|', '\p')) + CASE WHEN k > 1 THEN 8 ELSE 0 END END)
        + 8)::BIGINT AS formatted_chars,
       sum(CASE WHEN k > 1 AND prev = role THEN 0 ELSE 1 END)::BIGINT AS n_blocks
FROM turns GROUP BY conv_id
"""
