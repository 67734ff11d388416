"""Near-duplicates by the Jaccard similarity of word shingles, found without loss.

A text is the set of its distinct shingles' hashes, in one order for all texts. Two sets of
similarity s share one of the first n - ceil(s * n) + 1 hashes of either (prefix filter), so
these are the keys. Hashes that many texts of a sample hold come last in the order: it makes
keys rare and any order is right. Pairs are settled by counting what both sets hold.

Every key first links its sets to its smallest one, which joins large groups in as many pairs
as there are keys. Sets that this left in different groups are then paired by all their keys;
only pairs with as many common keys as similar sets must have are settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import words, written

WORDS = 5
SAMPLE, HOT = 2_000, 4  # texts of the sample (about), and of them that hold a hot shingle at least
MOST_HOT = 200_000
HELD = 500  # texts whose hashes are held at once


def hashes(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text with fewer words is one shingle."""
    w = words(text)
    k = min(shingle, len(w))
    parts = zip(*(w[i:] for i in range(k)), strict=False)
    found = {xxhash.xxh64_intdigest(b" ".join(s), 42) for s in parts}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def signature(text: str | None, shingle: int = WORDS) -> int:
    """One 64-bit hash of the set; 0 for texts without words."""
    own = hashes(text, shingle)
    return xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0


def hot(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Sorted shingle hashes that several texts of a sample hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": hashes(t, shingle).view(np.int64)})

    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    share = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates()
    counts = sample.mapInPandas(run, "h long").groupBy("h").count().where(F.col("count") >= HOT)
    return np.sort(counts.orderBy(F.desc("count"), "h").limit(MOST_HOT).toPandas()["h"].to_numpy(dtype=np.int64))


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int = WORDS) -> DataFrame:
    """(id, fp, n, hashes): a text's signature, size and ordered set."""
    common = docs.sparkSession.sparkContext.broadcast(hot(docs, text_col, shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = common.value
        for b in batches:
            for s in range(0, len(b), HELD):
                part, out, fp = b.iloc[s:s + HELD], [], []
                for t in part["text"]:
                    own = hashes(t, shingle)
                    fp.append(xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0)
                    own = own.view(np.int64)
                    last = np.isin(own, late)
                    out.append(np.concatenate((own[~last], own[last])))
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "fp": np.array(fp, dtype=np.uint64).view(np.int64),
                    "n": [len(x) for x in out], "hashes": out,
                }).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, fp long, n int, hashes array<long>")


def _prefix(n: Column, least: float) -> Column:
    """How many hashes of a set of n are keys."""
    return (n - F.ceil(n * least - 1e-9) + 1).cast("int")


def _may(least: float, n: Column, m: Column, most: Column) -> Column:
    """Whether sets of n and m hashes with at most so many common ones can be similar."""
    return most / (n + m - most) >= least


def similar(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    own = rows.select("fp", "hashes").join(ends, "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))
    own = written(own, "compared_sets")
    a, b = (own.select(F.col("fp").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    share = both / (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(a, "a").join(b, "b").where(share >= least).select("a", "b")


def links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between signatures that join all sets of ``rows`` of similarity ``least``."""
    n, m, at, to = (F.col(c) for c in ("n", "m", "at", "to"))
    keys = rows.where("n > 0").select("fp", "n", F.posexplode(F.slice("hashes", F.lit(1), _prefix(n, least))).alias("at", "key"))
    shared = keys.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first < last")
    keys = written(keys.join(shared.select("key", "first"), "key").distinct(), "shared_keys")
    first = keys.where("fp = first").select("key", n.alias("m"), at.alias("to"))
    near = _may(least, n, m, F.least(n - at, m - to))  # the first common hash is a key with these places
    even = F.least(n, m) / F.greatest(n, m) >= least
    pairs = keys.where("fp <> first").join(first, "key").where(even & near).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    found = written(similar(written(pairs.distinct(), "first_pairs"), rows, least), "first_links")
    group = found.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("linked"))
    x = keys.join(group, "fp", "left").select("key", "fp", "n", "at", F.coalesce("linked", "fp").alias("group"))
    open_keys = x.groupBy("key").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g < h").select("key")
    x = written(x.join(open_keys, "key", "left_semi"), "open_keys")
    y = x.select("key", F.col("fp").alias("fp_"), n.alias("m"), at.alias("to"), F.col("group").alias("group_"))
    across = x.join(y, "key").where("fp < fp_ AND group <> group_").where(even)
    across = across.groupBy(F.col("fp").alias("a"), F.col("fp_").alias("b"), "n", "m").agg(
        F.count("*").alias("both"), F.max("at").alias("at"), F.max("to").alias("to")
    )
    rest = F.least(n - at - 1, m - to - 1, F.greatest(n - _prefix(n, least), m - _prefix(m, least)))
    across = written(across.where(_may(least, n, m, F.col("both") + rest)).select("a", "b"), "other_pairs")
    return found.unionByName(similar(across, rows, least))
