"""Reproducible sampling, splitting and shuffling by keyed row hashes.

The hash depends on seed and key only, so results do not change with partitioning, and
its prefix spreads any key distribution evenly. Keys must identify rows and come out the
same in every evaluation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.text import below_rate, digest

_PREFIX = 4  # hex digits: 65,536 slices, also the size bound of every slice table


def _hash(seed, key: Sequence[str]) -> Column:
    return digest(seed, *[F.col(k) for k in key])


def bernoulli(df: DataFrame, rate: float, seed, key: Sequence[str]) -> DataFrame:
    """Keep each row with probability ``rate``. Use it before parsing."""
    return df.where(below_rate(_hash(seed, key), rate))


def _ending_slice(hashed: DataFrame, n: Column, level: int) -> tuple[DataFrame, Column]:
    """Rows of the slice, by the digits of a level, where the first ``n`` end, and how many of it to take."""
    piece = F.substring("h", 1 + _PREFIX * level, _PREFIX)
    before = W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        hashed.groupBy(piece.alias("piece")).agg(F.count("*").alias("n_rows"))
        .withColumn("n_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .where((F.col("n_before") < n) & (F.col("n_before") + F.col("n_rows") >= n))
    )
    ending = slices.agg(
        F.struct(F.max("piece").alias("piece"), (n - F.max("n_before")).alias("take")).alias("e")
    ).scalar()
    return hashed.where(piece == ending["piece"]), ending["take"]


def exact(df: DataFrame, n: int | Column, seed, key: Sequence[str]) -> DataFrame:
    """Sample ``n`` rows without replacement: those with the smallest hashes.

    Three passes over the keys find the n-th hash: counts by the first digits, counts by the
    next digits in the one slice where the sample ends, and the rank inside the one slice of
    those, which holds a row in 2^32. The rows themselves are only filtered, never shuffled.
    Fewer than ``n`` rows are all kept.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    hashed = df.select(_hash(seed, key).alias("h"))
    for level in range(2):
        hashed, n_left = _ending_slice(hashed, n if level == 0 else n_left, level)
    last = (
        hashed.select("h", F.row_number().over(W.orderBy("h")).alias("rank"))
        .where(F.col("rank") <= n_left)
        .agg(F.max("h").alias("last")).scalar()
    )
    beyond_all = F.lit("g")  # sorts after every hex digest
    return df.where((n > 0) & (_hash(seed, key) <= F.coalesce(last, beyond_all)))


def shuffle(
    df: DataFrame, seed, key: Sequence[str], name: str = "shuffle_pos"
) -> DataFrame:
    """Add each row's position in the seeded permutation.

    Positions are numbered inside hash slices and shifted by the counts of the slices
    before; the slices are even, whatever the keys look like.
    """
    hashed = df.withColumn("_hash", _hash(seed, key))
    hashed = hashed.withColumn("_piece", F.substring("_hash", 1, _PREFIX))
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_piece").agg(F.count("*").alias("_n"))
        .select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(W.partitionBy("_piece").orderBy("_hash", *key))
    return (
        hashed.join(F.broadcast(starts), "_piece")
        .withColumn(name, F.col("_start") + rank - 1)
        .drop("_hash", "_piece", "_start")
    )


def train_test(
    df: DataFrame, test_share: float, seed, key: Sequence[str], name: str = "split"
) -> DataFrame:
    """Label rows ``train`` or ``test``."""
    in_test = below_rate(_hash(seed, key), test_share)
    return df.withColumn(name, F.when(in_test, "test").otherwise("train"))
