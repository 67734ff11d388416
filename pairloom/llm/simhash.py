"""Near-duplicates by 64-bit fingerprints, found with Golay-code keys.

A fingerprint falls into three segments of 22, 21 and 21 bits. Three differing bits spread
over them in one of two ways:

* Some segment has none. Then, for the segments in a ring, one of the three pairs (equal
  segment, next segment within two bits) holds. Keys: the equal segment with each Golay index
  near the next one, at most 18 a fingerprint.
* Each segment has one. Then the index of a segment is among the indices near its partner's.
  One side of the join lists the indices near the first and third segments with the index of
  the second, the other side the reverse, at most 42 keys of 36 bits.

Equal keys bring candidates together; only pairs within three bits become links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import golay, shingles
from pairloom.llm.common import PART_TEXTS, in_parts, words, written
from pairloom.llm.components import components

MAX_BITS = 3
SHIFTS, SIZES = (0, 22, 43), (22, 21, 21)
BUCKET = 20_000  # fingerprints of one key that are compared in one piece
_PIECE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a text: bits set in over half of its shingles' XXH64 (seed 42)."""
    w = words(text)
    if not w:
        return 0
    k = min(shingle, len(w))
    ones, n = np.zeros(64, dtype=np.int64), len(w) - k + 1
    for start in range(0, n, _PIECE):
        part = w[start:start + _PIECE + k - 1]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(k)), strict=False)),
            dtype="<u8", count=min(_PIECE, n - start),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and wordless texts have 0."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(compute, "id long, fp long")


def key_rows(fp: np.ndarray) -> pd.DataFrame:
    """Rows (key, side, fp); side 0 meets all, side 1 meets side 2."""
    u = fp.view(np.uint64)
    segments = [(u >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(SHIFTS, SIZES, strict=True)]
    near = [golay.nearby(x, n) for x, n in zip(segments, SIZES, strict=True)]
    own = [golay.decode(x) for x in segments]
    out = []

    def add(keys: np.ndarray, valid: np.ndarray, side: int) -> None:
        row, _ = np.nonzero(valid)
        out.append((keys[valid], np.full(len(row), side, dtype=np.int8), fp[row]))

    for i in range(3):
        found, valid = near[(i + 1) % 3]
        add((i << 60) | (segments[i][:, None] << 12) | found, valid, 0)
    (f0, v0), (f1, v1), (f2, v2) = near
    n = len(fp)
    both = ((3 << 60) | (f0[:, :, None] << 24) | (own[1][:, None, None] << 12) | f2[:, None, :]).reshape(n, -1)
    add(both, (v0[:, :, None] & v2[:, None, :]).reshape(n, -1), 1)
    add((3 << 60) | (own[0][:, None] << 24) | (f1 << 12) | own[2][:, None], v1, 2)
    key, side, of = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"key": key, "side": side, "fp": of})


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within MAX_BITS that join all distinct fingerprints which such links join."""
    left, links = np.unique(fp.view(np.uint64)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(left ^ x) <= MAX_BITS
            found, left = left[close], left[~close]
            links += [(x, y) for y in found]
            queue += list(found)
    return [tuple(np.array(p, dtype=np.uint64).view(np.int64)) for p in links]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each run of equal keys; the last run of a batch waits for the next batch."""
    names = ["key", "lo", "hi"]
    wait: list[pd.DataFrame] = []

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows[names].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1))))
        ends = np.append(starts[1:], len(rows))
        fp, side, found = rows["fp"].to_numpy(), rows["side"].to_numpy(), []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if side[s] == 0 or len(np.unique(side[s:e])) == 2:
                found += forest(fp[s:e])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for b in batches:
        if not len(b):
            continue
        rows = pd.concat([*wait, b], ignore_index=True)
        ids = rows[names].to_numpy()
        cut = int(np.flatnonzero((ids != ids[-1]).any(axis=1))[-1]) + 1 if (ids[0] != ids[-1]).any() else 0
        wait = [rows[cut:]]
        if cut:
            yield links(rows[:cut])
    if wait:
        yield links(wait[0].reset_index(drop=True))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all fingerprints of ``distinct`` (fp) which links join.

    A key with more than ``bucket`` fingerprints is dealt in pieces, every two of which are
    compared by a task of their own. A task gives at most one link for each fingerprint.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield key_rows(b["fp"].to_numpy(dtype=np.int64))

    keys = distinct.select("fp").mapInPandas(make, "key long, side byte, fp long")
    large = written(keys.groupBy("key").count().where(F.col("count") > bucket), "large_keys")
    pieces = keys.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    if not large.isEmpty():
        n = F.ceil(F.col("count") * 2 / bucket).cast("int")
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        dealt = keys.join(large, "key").select(
            "key", "side", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
        ).select("key", "side", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        pieces = pieces.join(large, "key", "left_anti").unionByName(dealt)
    return (
        pieces.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side")
        .mapInPandas(_compare, "a long, b long").distinct()
    )


def _groups(rows: DataFrame, find: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, root, component_id): a fingerprint's group and the group's smallest id, of rows (id, fp)."""
    classes, n = rows.groupBy("fp").agg(F.min("id").alias("least")), rows.count()
    joined = components(find(classes), nodes=n)
    nodes = joined.join(classes, joined.node == classes.fp).select("node", "root", "least")
    roots = nodes.groupBy("root").agg(F.min("least").alias("reached"))
    reach = nodes.join(roots, "root").select(F.col("node").alias("fp"), "root", "reached", F.lit(True).alias("linked"))
    groups = classes.join(reach, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("linked"), F.col("reached")).otherwise(F.col("least")).alias("component_id"),
    )
    return in_parts(groups, n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link if they differ in at most three bits; ``component_id`` is the smallest
    id that links reach. Repeated rows stay; ids may repeat or be null (a component of null
    ids has a null id). Null, empty and wordless texts share fingerprint 0 and so link with
    each other. An empty table gives an empty result; other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = written(_groups(rows), "groups")  # a table of its own, so a hot fingerprint's rows can be split
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id.

    Groups are those of ``near_duplicates``, or with ``similarity`` texts that links of that
    Jaccard similarity of their sets of shingles join. Of a group's several rows with that id
    those of the smallest fingerprint count and one of them stays, so an id that has texts in
    several groups may stay once for each; of a group without ids one row stays. Texts are only
    hashed again where several rows share an id; ids alone decide about the others.
    """
    if similarity is None:
        sign = fingerprint
        rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        groups = written(_groups(rows), "groups")
    else:
        sign = shingles.signature
        rows = written(shingles.sets(docs, id_col, text_col, shingle), "sets")
        groups = written(_groups(rows, lambda _: shingles.links(rows, similarity)), "groups")
    named = rows.where("id IS NOT NULL")
    kept = named.join(groups, "fp").where("id = component_id").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("own"))
    kept = kept.select("own.*").join(named.groupBy("id").agg(F.count("*").alias("rows")), "id")
    n = rows.count()
    kept = written(in_parts(kept, n), "kept")
    key = F.col(id_col).cast("long") == F.col("id")
    once = docs.join(kept.where("rows = 1").select("id"), key, "left_semi")

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([np.uint64(sign(t, shingle)).astype(np.int64) for t in texts], dtype="int64")

    several = kept.where("rows > 1").select("id", F.col("fp").alias("kept_fp"))  # such an id may stand for several texts
    again = docs.join(several.select("id").distinct(), key, "left_semi").withColumn("_fp", fp(F.col(text_col)))
    again = again.join(several, key & (F.col("_fp") == F.col("kept_fp")), "left_semi")
    again = again.dropDuplicates([id_col, "_fp"]).drop("_fp")
    own = docs.where(F.col(id_col).isNull()).withColumn("_fp", fp(F.col(text_col)))
    nameless = groups.where("component_id IS NULL").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    unnamed = own.join(nameless, "_fp").dropDuplicates(["_root"]).select(*docs.columns)
    return in_parts(once.unionByName(again).unionByName(unnamed), n, PART_TEXTS)
