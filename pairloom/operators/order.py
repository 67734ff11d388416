"""Row positions, prefixes and lookups in a declared order, without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.text import preview as cut_text
from pairloom.session import fresh_path

FEW = 10_000  # rows that meet in one task
SAMPLED = 20_000  # keys in a sample, about
_PART_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in ``order``.

    The rows are range-partitioned on the whole key, so one hot leading value is split
    over tasks. They are written once: positions inside partitions only mean something
    together with one fixed partitioning, also after a lost executor. The table of
    partition starts has one row per shuffle partition.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "ranged")
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    ranged = spark.read.parquet(path).withColumn("_part", F.shiftright("_mid", _PART_BITS))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_mid", "_part", "_start")
    )


def first_n(df: DataFrame, n: int, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """The first ``n`` rows in ``order`` (nulls first) with their positions.

    Up to FEW rows every task keeps its first ``n`` and these meet in one task; the input is read
    once and nothing is written. For more, ``at_or_before`` narrows the input to little more
    than ``n`` rows, and only these are put in order, in range partitions.
    """
    if n > FEW:
        indexed = with_row_index(at_or_before(df, n, order), order, name)
        return indexed.where(F.col(name) < n)
    numbered = F.row_number().over(W.orderBy(*order)).cast("bigint") - 1
    return df.orderBy(*order).limit(max(n, 0)).withColumn(name, numbered)


def at_or_before(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Rows among which the first ``n`` in ``order`` are, hardly more of them; without a sort of the input.

    A sample of about SAMPLED keys names one that is at least ``n``-th, rows beyond it are
    filtered away, and the rest is sampled again, until the sample can't narrow it further.
    Every round counts exactly what is left, so the result doesn't depend on the sample. What
    one task orders is a sample; key columns are compared as a whole, nulls first.
    """
    key = F.struct(*order)
    left, total = df, df.count()
    while total > max(2 * n, SAMPLED):
        share = SAMPLED / total
        rank = int(n * share + 4 * (n * share) ** 0.5 + 8)  # beyond the n-th key, but for bad luck
        drawn = left.select(key.alias("key")).sample(share, seed=total)
        ranked = drawn.select("key", F.row_number().over(W.orderBy("key")).alias("rank")).where(F.col("rank") == rank)
        path = fresh_path(df.sparkSession, "cut")
        ranked.select("key").write.parquet(path)  # one row, or none; fixed, as samples are not
        cut = df.sparkSession.read.schema(ranked.select("key").schema).parquet(path)
        if cut.isEmpty():
            break
        narrowed = df.where(key <= cut.agg(F.max("key")).scalar())
        held = narrowed.count()
        if not n <= held < total:
            break
        left, total = narrowed, held
    return left


def lookup(df: DataFrame, positions: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows at given 0-based positions."""
    return first_n(df, max(positions) + 1, order).where(F.col("row_idx").isin(list(positions)))


def preview(df: DataFrame, column: str, n: int, width: int, order: Sequence[str]) -> DataFrame:
    """First few rows for people to look at, long texts cut."""
    shown = df.orderBy(*order).limit(n)
    return shown.withColumn(column, cut_text(F.col(column), width))


def with_batch_id(
    df: DataFrame, size: int, order: Sequence[str], name: str = "batch_id"
) -> DataFrame:
    """Number batches of ``size`` consecutive rows."""
    indexed = with_row_index(df, order)
    return indexed.withColumn(name, F.floor(F.col("row_idx") / size).cast("bigint"))
