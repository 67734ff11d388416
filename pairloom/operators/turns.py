"""Chat rendering of turn tables, one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import chat, fixed


def render_turn_rows(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    content: str = "text",
) -> DataFrame:
    """``gemma`` segment per turn; in turn order they make up the conversation's text.

    A system turn at the start becomes the prefix of the turn after it, whatever its number;
    a conversation of a system turn alone is its head without turns. Of rows that tie for the
    first number the least system row is the prefix, the others are rendered and take it.
    The first two turns of a conversation are found with partial aggregates and joined back,
    so nothing is collected per conversation and one endless conversation is spread like any
    other rows.
    """
    is_system = F.coalesce(F.col(role) == "system", F.lit(False))
    place = F.struct(F.col(turn).alias("turn"), (~is_system).alias("said"), F.col(role).alias("role"), F.col(content).alias("text"))
    first = turns.groupBy(conversation).agg(F.min(place).alias("_first"))
    system = ~F.col("_first.said")
    marked = turns.join(first.withColumnRenamed(conversation, "_conv"), F.col(conversation).eqNullSafe(F.col("_conv")))
    is_first = F.col(turn).eqNullSafe(F.col("_first.turn"))
    opening = system & is_first & is_system & F.col(content).eqNullSafe(F.col("_first.text"))
    later = marked.where(system & ~opening).groupBy("_conv").agg(
        F.min(F.struct(F.col(turn).alias("turn"))).alias("_second")
    ).withColumnRenamed("_conv", "_of")
    rows = marked.join(later, F.col("_conv").eqNullSafe(F.col("_of")), "left")
    alone = F.col("_second").isNull()
    takes_system = system & ~opening & F.col(turn).eqNullSafe(F.col("_second.turn"))
    opens = takes_system | opening | (is_first & ~system)
    prefix = F.when(takes_system, F.concat(F.col("_first.text"), F.lit("\n\n"))).otherwise("")
    segment = F.concat(
        F.when(opens, fixed.BOS).otherwise(""),
        F.when(opening, F.concat(F.col(content), F.lit("\n\n"))).otherwise(
            chat.chat_turn(F.col(role), F.concat(prefix, F.col(content)))
        ),
    )
    return rows.where(~opening | alone).select(conversation, turn, segment.alias("segment"))
