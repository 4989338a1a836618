"""Operator 7, chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users. System turns stay what
they are and are nobody's perspective. The loss mask covers the assistant's
own texts with their end mark. A row is one turn seen by one participant, with
its place in the rendered dialogue, so that no conversation has to fit in a task.

Turns are ordered by turn, then role and text. Null texts are empty. A null or
blank role speaks as the user ``unnamed`` and has no perspective of its own. A
null conv_id is one conversation. Conversations without any participant give no
row. Repeated rows are turns of their own. Marks inside texts and names are
broken up, so that none can be forged. Further columns are dropped. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.tables import lines_up, run_offsets, stored

SYSTEM, UNNAMED, END = "system", "unnamed", "<|end|>\n"
#: Turns whose offsets are summed together.
BLOCK = 256


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _unmarked_name(name: Column) -> Column:
    """With nothing that could end the header, or begin a mark with the end of it."""
    return F.regexp_replace(F.replace(_unmarked(name), F.lit("|>"), F.lit("| >")), "<$", "< ")


def _header(kind: Column, name: Column) -> Column:
    return F.when(kind == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>\n")))


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, name, text, turn_index (from 0 in each conversation)."""
    name = F.trim(F.translate(F.col("role").cast("string"), "\r\n", "  "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.length(name) > 0, _unmarked_name(name)).alias("name"),
        _unmarked(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    lined = stored(lines_up(rows, F.col("conv_id"), F.col("turn"), F.col("name"), F.col("text")), "turns")
    number = (F.col("before") + F.col("at")).alias("number")
    numbered = lined.join(run_offsets(lined, F.count(F.lit(1))), "run").select("conv_id", "turn", "name", "text", number)
    firsts = numbered.groupBy(F.col("conv_id").alias("conv")).agg(F.min("number").alias("first"))
    met = numbered["conv_id"].eqNullSafe(firsts["conv"])
    return numbered.join(firsts, met).select("conv_id", "turn", "name", "text", (F.col("number") - F.col("first")).alias("turn_index"))


def rotated(turns: DataFrame) -> DataFrame:
    """A row per turn and perspective.

    conv_id, perspective, turn_index, turn, kind (assistant, user or system),
    name, rendered, char_start and char_end (in the dialogue, code points),
    is_target, mask_start and mask_end (an empty span at the end if no target).
    """
    numbered = _numbered(turns)
    speakers = numbered.where((F.col("name") != SYSTEM) & F.col("name").isNotNull()).select(F.col("conv_id").alias("conv"), F.col("name").alias("perspective")).distinct()
    kind = F.when(F.col("name") == SYSTEM, SYSTEM).when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    seen = (
        numbered.join(speakers, numbered["conv_id"].eqNullSafe(speakers["conv"]))
        .withColumn("kind", F.coalesce(kind, F.lit("user")))
        .withColumn("name", F.coalesce("name", F.lit(UNNAMED)))
        .withColumn("header", _header(F.col("kind"), F.col("name")))
        .withColumn("rendered", F.concat("header", "text", F.lit(END)))
        .withColumn("block", F.floor(F.col("turn_index") / BLOCK))
    )
    length = F.length("rendered").cast("long")
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum(length).alias("chars"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("skipped")
    )
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    summed = seen.withColumn("upto", F.sum(length).over(inside))
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    target = F.col("kind") == "assistant"
    end = F.col("skipped") + F.col("upto")
    return summed.join(blocks, met).select(
        "conv_id",
        "perspective",
        "turn_index",
        "turn",
        "kind",
        "name",
        "rendered",
        (end - length).alias("char_start"),
        end.alias("char_end"),
        target.alias("is_target"),
        F.when(target, end - length + F.length("header")).otherwise(end).alias("mask_start"),
        F.when(target, end - 1).otherwise(end).alias("mask_end"),
    )
