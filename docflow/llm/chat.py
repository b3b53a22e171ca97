"""Chat formatting by perspective rotation: for every participant of a conversation the dialogue is rendered with that speaker as
the assistant and all others as named users, with the loss mask on the assistant's words. DataFrame functions only.

Defined results: a role of null is the speaker "unknown"; a null text is empty; rows whose conv_id is null form one conversation;
turns are ordered by turn (nulls first), then role, then text, and repeated rows are repeated turns; a conversation of system turns
only has no participant and gives no rows; markers inside a text are defused; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: Turns with numbers in one span of this length are numbered together, so that a long conversation is split.
SPAN = 256


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, body, with markers in texts defused."""
    body = F.replace(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), body.alias("body"))


def participants(said: DataFrame) -> DataFrame:
    """The distinct speakers of each conversation but the system."""
    return said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()


def rotate(conversations: DataFrame) -> DataFrame:
    """One row for each perspective and turn: conv_id, perspective, turn, position, role, name, segment, trainable, and the half-open
    character ranges of the segment in the rendered dialogue and of the trained part (null where nothing is trained).

    Joining the segments of a perspective by position gives the dialogue. Offsets are running sums inside spans of turns plus the
    sums of the spans before, so that no conversation is gathered in one task.
    """
    said = turns(conversations).withColumn("span", F.floor(F.col("turn") / SPAN))
    who = participants(said).withColumnRenamed("conv_id", "of")
    every = said.join(who, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(~own & (F.col("speaker") != SYSTEM), F.col("speaker"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    every = every.select("conv_id", "perspective", "turn", "span", "speaker", "body", role.alias("role"), name.alias("name"), head.alias("head"), own.alias("trainable")).withColumn(
        "segment", F.concat("head", "body", F.lit(END + "\n"))
    )
    inside = Window.partitionBy("conv_id", "perspective", "span").orderBy("turn", "speaker", "body")
    rows = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = every.withColumn("n", F.row_number().over(inside)).withColumn("upto", F.sum(F.length("segment")).over(rows))
    spans = every.groupBy("conv_id", "perspective", "span").agg(F.count("*").alias("rows"), F.sum(F.length("segment")).alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("span")
    shifts = spans.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("span").alias("s"),
        (F.sum("rows").over(before) - F.col("rows")).alias("rows_before"), (F.sum("chars").over(before) - F.col("chars")).alias("chars_before"),
    )
    joined = numbered.join(shifts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("span").eqNullSafe(F.col("s")))
    end = F.col("chars_before") + F.col("upto")
    start = end - F.length("segment")
    return joined.select(
        "conv_id", "perspective", "turn", (F.col("rows_before") + F.col("n") - 1).alias("position"), "role", "name", "segment", "trainable",
        start.alias("segment_start"), end.alias("segment_end"),
        F.when(F.col("trainable"), start + F.length("head")).alias("mask_start"), F.when(F.col("trainable"), end - 1).alias("mask_end"),
    )


def dialogues(conversations: DataFrame) -> DataFrame:
    """One row for each perspective with the whole dialogue and its mask ranges; for conversations that fit a row."""
    parts = rotate(conversations).groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end"))).alias("parts"))
    return parts.select(
        "conv_id", "perspective", F.array_join(F.col("parts.segment"), "").alias("dialogue"),
        F.transform(F.filter("parts", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("mask"),
    )


ROTATE_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS body
  FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
every AS (
  SELECT said.conv_id, perspective, turn, speaker, body, speaker = perspective AS trainable,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN speaker <> perspective AND speaker <> 'system' THEN speaker END AS name
  FROM said JOIN who ON said.conv_id IS NOT DISTINCT FROM who.conv_id),
headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM every),
whole AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS segment_end
  FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, role, name, segment, trainable,
       segment_end - length(segment) AS segment_start, segment_end,
       CASE WHEN trainable THEN segment_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN trainable THEN segment_end - 1 END AS mask_end
FROM placed
"""
