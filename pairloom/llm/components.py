"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import in_parts, written

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b", nodes: int | None = None) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node that has a link.

    Alternates two star steps: every node hands its larger neighbours to its smallest one,
    then its smaller neighbours and itself. The links end as stars around the roots, in a
    number of rounds that grows with the logarithm of the longest chain. Each round is a
    written table, so a lost executor costs one round at most; its files are as many as its
    links need, those of the first as many as ``nodes`` need, if given. Links with a null end
    and links of a node to itself count for nothing; without links the result is empty.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    first = (
        links.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u"))
        .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    )
    links = written(first if nodes is None else in_parts(first, nodes), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == before:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        before = tuple(now)
        links = written(in_parts(_small_star(_large_star(links)), now[0]), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    """Link each neighbour larger than a node to the smallest of the node's neighbourhood."""
    both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m"))
    moved = both.where("u > v").join(least, "v").select(
        F.col("u").alias("v"), F.least("v", "m").alias("u")
    )
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    moved = links.join(least, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
