"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation is taken as the assistant once; all others speak as named
users. Rows are messages with their place in the rendering, so no conversation has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.shared import positioned

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, neutral: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each message of each perspective: conv_id, perspective, position, speaker,
    chat_role, rendered, start (of rendered in the whole rendering, in characters), mask_start and
    mask_end (the characters that count for the loss: the assistant's text and its end mark; equal
    where none do).

    Messages stand by turn, then role, then text, nulls first; repeated rows are kept. A null role
    speaks as "unknown", a null text is empty, null conv_ids form one conversation. Roles in
    ``neutral`` are no participants and keep their role; a conversation of only such has no rows.
    Other columns are ignored."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = said.filter(~F.col("speaker").isin(*neutral)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    every = said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*neutral), F.col("speaker")).otherwise("user")
    name = F.when(role == "user", F.concat(F.lit(" name="), "speaker")).otherwise("")
    head = F.concat(F.lit(OPEN), role, name, F.lit("\n"))
    every = every.withColumns({"chat_role": role, "_head": F.length(head), "rendered": F.concat(head, "text", F.lit(CLOSE + "\n"))})
    every = every.withColumn("_length", F.length("rendered"))
    placed = positioned(every, ["conv_id", "perspective"], ["turn", "speaker", "text"], "_length")
    begin = F.col("start") + F.col("_head")
    return placed.select(
        "conv_id", "perspective", "position", "speaker", "chat_role", "rendered", "start",
        begin.alias("mask_start"), F.when(own, F.col("start") + F.col("_length") - 1).otherwise(begin).alias("mask_end"),
    )


ORACLE = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM said WHERE speaker <> 'system'),
e AS (SELECT s.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv),
h AS (SELECT *, '{OPEN}' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM e),
r AS (SELECT *, head || text || '{CLOSE}' || chr(10) AS rendered FROM h),
w AS (SELECT *, row_number() OVER o - 1 AS position,
  coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position, speaker, chat_role, rendered, start, start + length(head) AS mask_start,
  CASE WHEN speaker = perspective THEN start + length(rendered) - 1 ELSE start + length(head) END AS mask_end FROM w"""
