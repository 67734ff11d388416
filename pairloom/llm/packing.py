"""Best-fit packing of documents into sequences of several permitted lengths.

Items are token counts up to the largest permitted length, so the packing of any corpus is
fixed by a histogram of at most that many rows. Best-fit decreasing runs on counts: equal
items go into groups of equal bins. Its plan has a few ranges for each length, and every item
finds its bin by its rank among the items of its length. Neither bins nor items are gathered.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import tokens
from pairloom.llm.common import written

SIZES = (512, 1_024, 2_048, 4_096)
BIN_COST, SQUARE = 32.0, 1 / 32_768  # cost of a sequence besides its tokens: fixed, and for attention
SALTS = 256  # parts of the items of one length that are ranked apart
_RANKS = 40  # bits of a rank


def cost(size: int) -> float:
    return size + SQUARE * size * size + BIN_COST


@dataclass
class Plan:
    """Where items go. ``spots``: length, first rank, first bin, items a bin, offset; ``bins``: first bin, count, size."""

    spots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def cost(self) -> float:
        return sum(n * cost(size) for _, n, size in self.bins)


def _fill(length: int, size: int, rest: dict[int, int], shorter: list[int], tokens_to: list[int]) -> float:
    """Tokens that a bin opened for an item can hope for: copies of it, then shorter items."""
    own = min(rest[length], size // length)
    space = size - own * length
    at = bisect_left(shorter, min(space + 1, length))
    return own * length + min(space, tokens_to[at])


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, prefer: int | None = None) -> Plan:
    """Best-fit decreasing on counts; ``prefer`` opens that size wherever it holds the item."""
    out, rest = Plan(), dict(histogram)
    shorter = sorted(rest)
    tokens_to = [0, *np.cumsum([n * rest[n] for n in shorter]).tolist()]
    open_bins: dict[int, list[list[int]]] = {}  # space left: groups of first bin, count, size
    spaces: list[int] = []
    bins = 0

    def put(first: int, count: int, size: int, left: int) -> None:
        if left not in open_bins:
            open_bins[left] = []
            insort(spaces, left)
        open_bins[left].append([first, count, size])

    for length in reversed(shorter):
        rank, left_items = 0, rest[length]
        while left_items:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                left = spaces[at]
                first, count, size = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left], spaces[at]
            else:
                fits = [s for s in sizes if s >= length]
                rest[length] = left_items
                size = prefer if prefer in fits else min(
                    fits, key=lambda s: (cost(s) / _fill(length, s, rest, shorter, tokens_to), s)
                )
                left, first = size, bins
                count = -(-left_items // (size // length))
                bins += count
            each = left // length
            full = min(count, left_items // each)
            for n, k in ((full, each), (1, left_items % each if full < count else 0)):
                if n and k:
                    out.spots.append((length, rank, first, k, size - left))
                    put(first, n, size, left - k * length)
                    rank, left_items = rank + n * k, left_items - n * k
                    first, count = first + n, count - n
            if count:
                put(first, count, size, left)
    for left, groups in open_bins.items():
        for first, count, size in groups:
            out.bins.append((first, count, min(s for s in sizes if s >= size - left)))
    return out


def best_plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """The cheapest of the plans that open the least-cost size or, where it fits, one size each."""
    return min((plan(histogram, sizes, prefer) for prefer in (None, *sizes)), key=lambda p: p.cost)


def pack(lengths: DataFrame, id_col: str = "doc_id", n_col: str = "n_tokens", sizes: tuple[int, ...] = SIZES,
         salts: int = SALTS) -> DataFrame:
    """(id, piece, first_token, n_tokens, bin_id, start, capacity): the place of every piece of every row.

    A document longer than the largest size is cut into pieces of that size and a rest.
    ``start`` is the piece's first position in its sequence, ``capacity`` the sequence's final
    length: the smallest permitted one that holds its contents. Repeated rows are packed each.
    Rows with a null, zero or negative length give one row with null place. An empty table
    gives an empty result; other columns are not read.
    """
    sizes = tuple(sorted(sizes))
    largest = sizes[-1]
    rows = lengths.select(F.col(id_col).alias("id"), F.col(n_col).cast("long").alias("n"))
    pieces = rows.where("n > 0").select(
        "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece")
    ).select(
        "id", "piece", F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("length"),
        F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).alias("salt"),
    )
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("items"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["items"] for r in counts.groupBy("length").agg(F.sum("items").alias("items")).collect()}
    chosen = best_plan(histogram, sizes)
    spots = np.array(sorted(chosen.spots), dtype=np.int64).reshape(-1, 5)
    keys = spots[:, 0] << _RANKS | spots[:, 1]
    bins = np.array(sorted(chosen.bins), dtype=np.int64).reshape(-1, 3)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            _, first_rank, first, each, offset = spots[np.searchsorted(keys, length << _RANKS | rank, "right") - 1].T
            bin_id = first + (rank - first_rank) // each
            yield pd.DataFrame({
                "id": b["id"], "piece": b["piece"], "length": length, "bin_id": bin_id,
                "start": offset + (rank - first_rank) % each * length,
                "capacity": bins[np.searchsorted(bins[:, 0], bin_id, "right") - 1, 2],
            })

    order = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = pieces.withColumn("row", F.row_number().over(order)).join(before, ["length", "salt"]).select(
        "id", "piece", "length", (F.col("before") + F.col("row") - 1).alias("rank")
    )
    kind = rows.schema["id"].dataType.simpleString()
    placed = ranked.mapInPandas(
        place, f"id {kind}, piece long, length long, bin_id long, start long, capacity long"
    )
    none = F.lit(None).cast("long")
    out = placed.unionByName(rows.where("n IS NULL OR n <= 0").select(
        "id", none.alias("piece"), F.lit(0).cast("long").alias("length"), none.alias("bin_id"), none.alias("start"),
        none.alias("capacity"),
    ))
    return out.select(
        F.col("id").alias(id_col), "piece", (F.col("piece") * largest).alias("first_token"),
        F.col("length").alias("n_tokens"), "bin_id", "start", "capacity",
    )


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): ids of each text by the tokenizer, and one for the end of the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all = tokens.encoder(tokenizer).encode_all
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n": [len(ids) // 4 + 1 for ids in encode_all(b["text"])]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(run, "id long, n long")
    return counted.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``pack`` over the token counts of whole texts; null and empty texts are their end token alone."""
    return pack(written(token_lengths(docs, tokenizer, id_col, text_col), "token_lengths"), id_col, "n_tokens", sizes)
