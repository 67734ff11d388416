"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are its words and pairs of neighbouring words. A task interns the features
of many texts at once in an open-addressed table of NumPy arrays: the place of a feature
follows from its XXH64, a hit counts only if the bytes are equal too, and every slot has the
feature's bucket and its number of occurrences. One pass adds slot counts up by bucket, the
other lets the slot ids of all occurrences gather the buckets' gains.

Documents are drawn without replacement by Gumbel keys: the weight plus noise that follows from
the id alone. Places in that order come from range partitions, not from one sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written
from pairloom.operators.order import with_row_index

BUCKETS, SCALE = 10_000, 1_000
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
HELD = 1 << 16  # words of texts that are interned together
SEED_OF_KEYS = 42

FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()  # marks become blanks


_P = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(data: bytes, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of each string: short ones all at once, step by step of the public definition, long ones one by one."""
    p1, p2, p3, p4, p5 = _P
    lanes = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = np.uint64(SEED_OF_KEYS) + p5 + size.astype(np.uint64)
    short = np.flatnonzero(size < 32)
    for lane in range(3):
        own = short[size[short] >= 8 * lane + 8]
        k = _turned(lanes[first[own] + 8 * lane] * p2, 31) * p1
        h[own] = _turned(h[own] ^ k, 27) * p1 + p4
    at, rest = first + (size & ~7), size & 7
    own = short[rest[short] >= 4]
    h[own] = _turned(h[own] ^ (lanes[at[own]] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    at[own] += 4
    rest &= 3
    for byte in range(3):
        own = short[rest[short] > byte]
        h[own] = _turned(h[own] ^ raw[at[own] + byte].astype(np.uint64) * p5, 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[first[k]:first[k] + size[k]], SEED_OF_KEYS)
    return h


class Table:
    """Interns byte strings; equal strings get equal slots, others never do."""

    def __init__(self, data: bytes, first: np.ndarray, size: np.ndarray) -> None:
        """Intern the strings ``data[first:first + size]``.

        ``slot`` has the slot of every occurrence. ``count`` and ``bucket`` are of each slot.
        """
        n = len(first)
        bits = max(int(2 * n - 1).bit_length(), 1)
        raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
        self._probe(hashes(data, raw, first, size), raw, first, size, bits)
        owner = self.owner[self.used]
        self.bucket = np.zeros(1 << bits, dtype=np.int64)
        self.bucket[self.used] = [crc32(data[a:b]) % BUCKETS for a, b in zip(first[owner].tolist(), (first + size)[owner].tolist(), strict=True)]

    def _probe(self, key: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray, bits: int) -> None:
        mask = (1 << bits) - 1
        self.owner = np.full(1 << bits, -1, dtype=np.int64)  # the occurrence whose string a slot holds
        self.slot = np.empty(len(key), dtype=np.int64)
        waiting, at = np.arange(len(key)), (key & np.uint64(mask)).astype(np.int64)
        while len(waiting):
            free = self.owner[at] < 0
            self.owner[at[free]] = waiting[free]  # of several that claim a slot the last one has it
            own = self.owner[at]
            same = key[own] == key[waiting]
            same[same] = self._equal(raw, first, size, own[same], waiting[same])
            self.slot[waiting[same]] = at[same]
            waiting, at = waiting[~same], (at[~same] + 1) & mask
        self.count = np.bincount(self.slot, minlength=1 << bits)
        self.used = np.flatnonzero(self.count)

    @staticmethod
    def _equal(raw: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings of two lists of occurrences have the same bytes, eight compared at a time."""
        equal = size[a] == size[b]
        lanes = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        open_, done = np.flatnonzero(equal & (a != b)), 0
        while len(open_):
            x, y = a[open_], b[open_]
            rest = np.minimum(size[x] - done, 8)
            cut = (np.uint64(64) - 8 * rest.astype(np.uint64)) & np.uint64(63)
            differ = ((lanes[first[x] + done] ^ lanes[first[y] + done]) << cut) != 0
            equal[open_[differ]] = False
            done += 8
            open_ = open_[~differ & (size[x] > done)]
        return equal


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(FOLD).split()


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[list[bytes]], list[bool]]]:
    """Texts in portions of about HELD words: their numbers, words and whether the next portion goes on.

    A text that goes on gives its next portion's first word too, as the last pair needs it.
    """
    of, words, on, size = [], [], [], 0
    for k, text in enumerate(texts):
        w = plain_words(text)
        for s in range(0, len(w), HELD):
            part = w[s:s + HELD + 1]
            of.append(k)
            words.append(part)
            on.append(len(part) > HELD)
            size += len(part)
            if size >= HELD:
                yield of, words, on
                of, words, on, size = [], [], [], 0
    if of:
        yield of, words, on


def _features(words: list[list[bytes]], on: list[bool]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of texts in one string, place and size of each feature in it, and the text it is of."""
    data = b" ".join(b" ".join(w) for w in words)
    n = np.array([len(w) for w in words])
    blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)  # one between words, none in them
    first = np.concatenate(([0], blanks + 1))
    size = np.append(blanks, len(data)) - first
    text = np.repeat(np.arange(len(words)), n)
    last = np.cumsum(n) - 1
    single, pair = np.ones(len(size), dtype=bool), np.ones(len(size), dtype=bool)
    single[last[np.array(on)]] = False  # it is the next portion's
    pair[last] = False
    pairs = np.flatnonzero(pair)
    return (
        data, np.concatenate((first[single], first[pairs])),
        np.concatenate((size[single], size[pairs] + 1 + size[pairs + 1])), np.concatenate((text[single], text[pairs])),
    )


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): occurrences of features in all texts, by bucket; buckets without any are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for _, words, on in _pieces(b["raw"].tolist()):
                table = Table(*_features(words, on)[:3])
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    raw = docs.select(F.col(text_col).cast("string").cast("binary").alias("raw"))
    return raw.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each bucket: how much commoner it is in the target, in thousandths of a natural logarithm."""
    s = bucket_counts(docs, text_col).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    rows = both.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0).collect()  # BUCKETS rows
    rows.sort(key=lambda r: r["bucket"])  # sorted by Spark, all texts would be read once more to find ranges
    n_s, n_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    s, t = (np.array([r[k] for r in rows], dtype=np.float64) for k in "st")
    ratio = (t + 1) * float(n_s + BUCKETS) / ((s + 1) * float(n_t + BUCKETS))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each text's features, 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, n_words, total = (np.zeros(len(b), dtype=np.int64) for _ in range(3))
            for of, words, on in _pieces(b["raw"].tolist()):
                data, first, size, text = _features(words, on)
                table = Table(data, first, size)
                slot_gain = shared.value[table.bucket]
                own = np.array(of)
                np.add.at(n, own, np.bincount(text, minlength=len(of)))
                np.add.at(n_words, own, np.array([len(w) for w in words]) - np.array(on))
                sums = np.zeros(len(of), dtype=np.int64)
                np.add.at(sums, text, slot_gain[table.slot])
                np.add.at(total, own, sums)
            yield pd.DataFrame({"id": b["id"], "n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInPandas(run, "id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id, in thousandths; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``.

    Of the N rows with at least ``least_words`` words the ``percent * N // 100`` of the highest
    scores are drawn, ties to the smaller id (null ids last), and ranked from 1 in that order;
    other rows have a null rank. Null and empty texts have no features and weight 0. Repeated
    rows are rows of their own, with neighbouring ranks. An empty target leaves every bucket
    its background gain, an empty ``docs`` gives an empty result. Other columns are not read.
    """
    gain = gains(docs, target, text_col, target_text)
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = written(scored, "weights")
    enough = scored.where(F.col("n_words") >= least_words)
    n = enough.count() * percent // 100
    ordered = enough.select(
        (-F.col("score")).alias("back"), F.col("id").isNull().alias("nameless"), "id", "n_features", "weight", "score",
    )
    placed = with_row_index(ordered, ["back", "nameless", "id", "n_features", "weight"])
    rank = F.when(F.col("row_idx") < n, F.col("row_idx") + 1)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words)
    return placed.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
