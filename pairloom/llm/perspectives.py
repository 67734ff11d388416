"""Dialogues of several speakers, rendered once from each speaker's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ORDER = ["conv", "turn", "speaker", "text"]
_PART_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def _plain(x: Column) -> Column:
    """Content that can't open or close a turn."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def in_order(said: DataFrame) -> DataFrame:
    """Rows with ``place``, which grows in ORDER, and ``chunk``, the range of ORDER that a row is in.

    The ranges are written once, as places only mean something with one fixed partitioning.
    """
    ranged = said.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ranged = written(ranged.withColumn("place", F.monotonically_increasing_id()), "turns")
    return ranged.withColumn("chunk", F.shiftright("place", _PART_BITS))


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per conversation, participant and turn: the turn as that participant is trained on it.

    The participant's turns are the assistant's, those of others the turns of named users,
    system turns stay. Concatenated by ``position`` the segments are the dialogue; ``start``
    and ``stop`` are character offsets in it. ``loss_start`` and ``loss_stop`` span what the
    participant says, with the closing mark, and are null elsewhere.

    Participants are all speakers but the system; a conversation of system turns alone has
    no participant and no rows. Turns are in order of turn number (null first), then speaker,
    then text; equal rows are one turn. A null speaker is named ``unknown``, a null text is
    empty, rows without conversation id form one conversation. Other columns are not read.

    Nothing gathers a conversation: turns are range-partitioned by their whole order, and
    offsets are running sums within a range plus running sums over a conversation's ranges.
    """
    said = in_order(turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct())
    people = said.where(F.col("speaker") != system).select(
        F.col("conv").alias("of"), F.col("speaker").alias("participant")
    ).distinct()
    own, is_system = F.col("speaker") == F.col("participant"), F.col("speaker") == system
    role = F.when(is_system, "system").when(own, "assistant").otherwise("user")
    name = F.when(~is_system & ~own, F.col("speaker"))
    label = F.regexp_replace(_plain(F.col("name")), "[\\r\\n]", " ")
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), label), F.lit("")), F.lit("\n"))
    rows = said.join(people, F.col("conv").eqNullSafe(F.col("of"))).select(
        "conv", "participant", "turn", "speaker", role.alias("role"), name.alias("name"), "text",
        "place", "chunk",
    ).select("*", head.alias("head")).select(
        "*", F.concat("head", _plain(F.col("text")), F.lit(CLOSE)).alias("segment")
    )
    chunk = ["conv", "participant", "chunk"]
    within = Window.partitionBy(*chunk).orderBy("place")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv", "participant").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = rows.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("size"))
    sums = sums.select(
        *(F.col(c).alias(f"{c}_") for c in chunk),
        F.coalesce(F.sum("n").over(earlier), zero).alias("turns_before"),
        F.coalesce(F.sum("size").over(earlier), zero).alias("chars_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in chunk]
    placed = rows.select(
        "*", F.row_number().over(within).alias("n"),
        F.coalesce(F.sum(F.length("segment")).over(before), zero).alias("size"),
    ).join(sums, same[0] & same[1] & same[2])
    start = F.col("chars_before") + F.col("size")
    stop = start + F.length("segment")
    mine = F.col("role") == "assistant"
    return placed.select(
        F.col("conv").alias("conv_id"), "participant", (F.col("turns_before") + F.col("n") - 1).alias("position"),
        "turn", "speaker", "role", "name", F.col("segment").alias("text"), start.alias("start"), stop.alias("stop"),
        F.when(mine, start + F.length("head")).alias("loss_start"), F.when(mine, stop).alias("loss_stop"),
    )
