"""Batches of token ids, padded to the longest row of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import chat
from pairloom.operators.order import with_batch_id


def pad_to_longest(
    df: DataFrame, ids: str, size: int, order: Sequence[str], longest: int | None = None, pad_id: int = 0,
    side: str = "right", by_length: bool = False,
) -> DataFrame:
    """Number batches of ``size`` rows and add ``input_ids`` and ``attention_mask``, as long as the
    batch's longest row.

    Batches follow ``order``; ``by_length`` puts rows of like length together first, in range
    partitions of (length, order), which pads less. Rows are cut to ``longest`` ids before.
    Null arrays count as empty. Only lengths are aggregated; a batch has one row there, so the
    join back moves rows by batch and no batch is gathered.
    """
    kept = F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType))
    rows = df.withColumn(ids, F.slice(kept, 1, longest) if longest is not None else kept)
    rows = rows.withColumn("_size", F.size(ids))
    batched = with_batch_id(rows, size, ["_size", *order] if by_length else order)
    most = batched.groupBy("batch_id").agg(F.max("_size").alias("_most"))
    padded = chat.pad_truncate(F.col(ids), F.col("_most"), pad_id, side)
    return batched.join(most, "batch_id").select("*", padded.alias("_padded")).select(
        *df.columns, "batch_id", F.col("_padded.input_ids"), F.col("_padded.attention_mask")
    )


def padded_share(padded: DataFrame) -> DataFrame:
    """Share of the ids of padded batches that are padding."""
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return padded.agg((1 - F.sum(ones) / F.sum(F.size("attention_mask"))).alias("padded_share"))
