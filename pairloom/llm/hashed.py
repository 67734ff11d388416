"""Hashed terms of texts, labelled samples and distributed model averaging."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import in_parts, words, written

EDGES = b".,;:!?\"'()[]{}"
SHAPE = bytes(
    ord("0") if chr(c).isdigit() and c < 128 else ord("a") if c >= 128 or chr(c).isalpha() else c for c in range(256)
)
REPEATED = re.compile(rb"(.)\1+", re.DOTALL)
HELD = 500  # texts that are scored at once
SAMPLE = 20_000  # labelled rows that a model learns from
PARTS, PART_ROWS = 8, 2_500  # models that are averaged in a round at most, rows that one learns from at least
Params = dict[str, np.ndarray]


def terms(text: str | None, shapes: bool = False) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's words and of their first 4 and 5 bytes.

    Punctuation at the ends of words is removed. With ``shapes`` also of the words' shapes
    (letters as a, digits as 0, runs as one) and of the tenths of words that repeat the word
    before.
    """
    said = words(text)
    found = set(said)
    plain = {w.strip(EDGES) for w in found}
    hashes = {crc32(w) for w in plain}
    for n in (4, 5):
        hashes |= {crc32(w, n) for w in {w[:n] for w in plain if len(w) > n}}
    if shapes:
        hashes |= {crc32(REPEATED.sub(rb"\1", s), 1) for s in {w.translate(SHAPE) for w in found}}
        hashes.add(crc32(b"%d" % (10 * sum(map(eq, said, said[1:])) // max(1, len(said))), 2))
    return np.sort(np.fromiter(hashes, dtype=np.int64, count=len(hashes)))


def held_out(id_col: str, folds: int = 5) -> F.Column:
    """Whether the CRC of a row's id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled(
    docs: DataFrame, labels: DataFrame, grade: F.Column, id_col: str = "doc_id", text_col: str = "text",
    shapes: bool = False, sample: int = SAMPLE, name: str = "labelled",
) -> DataFrame:
    """Written table (id, x, y) of at most ``sample`` labelled rows that are not held out.

    Of the labelled ids that ``docs`` holds those with the smallest hashes are taken. A document with several labels has the
    largest, repeated documents count once, null ids and null grades are left out.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL").where(~held_out("id"))
        .groupBy("id").agg(F.max("y").alias("y"))
        .join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    )

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), HELD):
                part = b.iloc[s:s + HELD]
                yield pd.DataFrame({"id": part["id"], "y": part["y"], "x": [terms(t, shapes) for t in part["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids), "id").mapInPandas(hash_rows, "id long, y int, x array<long>")
    return written(in_parts(rows.groupBy("id", "y").agg(F.min("x").alias("x")), sample, PART_ROWS), name)


def vocabulary(rows: DataFrame, least: int, most: int) -> np.ndarray:
    """Sorted terms that ``least`` rows hold, at most ``most``, those of more rows first."""
    counts = rows.select(F.explode("x").alias("t")).groupBy("t").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "t").limit(most).toPandas()
    return np.sort(top["t"].to_numpy(dtype=np.int64))


def positions(vocab: np.ndarray, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the vocabulary of all rows' terms, and where each row starts."""
    sizes = np.fromiter((len(r) for r in x), dtype=np.int64, count=len(x))
    flat = np.concatenate(x) if len(x) else np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(x)), sizes)
    at = np.minimum(np.searchsorted(vocab, flat), max(len(vocab) - 1, 0))
    known = vocab[at] == flat if len(vocab) else np.zeros(len(flat), dtype=bool)
    starts = np.searchsorted(row[known], np.arange(len(x) + 1))
    return at[known], starts


def held_positions(vocab: np.ndarray, texts: pd.Series, shapes: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``positions`` of the texts' terms, HELD texts at a time, so a task holds few terms at once."""
    for s in range(0, max(len(texts), 1), HELD):
        yield positions(vocab, [terms(t, shapes) for t in texts.iloc[s:s + HELD]])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the slices between starts; empty ones are zero."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


class Descent:
    """Proximal Adagrad steps: each parameter has its own rate; l1 pulls it to exact zero."""

    def __init__(self, params: Params, rate: dict[str, float], l1: dict[str, float], calm: dict[str, float]) -> None:
        """``calm`` is what the summed squares start from: small values let first steps be long."""
        self.params, self.rate, self.l1 = params, rate, l1
        self.squares = {k: np.full(p.shape, calm.get(k, 1e-8)) for k, p in params.items()}

    def step(self, grads: Params) -> None:
        for k, g in grads.items():
            self.squares[k] += g * g
            pace = self.rate[k] / np.sqrt(self.squares[k])
            p = self.params[k] - pace * g
            lean = pace * self.l1.get(k, 0.0)
            self.params[k] = np.sign(p) * np.maximum(np.abs(p) - lean, 0)


def average(
    rows: DataFrame, params: Params, learn: Callable[[Params, list[np.ndarray], np.ndarray, int], Params], rounds: int
) -> Params:
    """Parameters after ``rounds`` rounds: each part learns from the common ones, then they are averaged.

    The driver gets PARTS parameter sets a round, whose size the vocabulary's bound sets.
    """
    names = list(params)
    parts = max(1, min(PARTS, rows.count() // PART_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    kinds = ", ".join(f"{k} binary" for k in names)

    def part(now: Params, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(got: pd.DataFrame) -> pd.DataFrame:
            got = got.sort_values("id")
            x = [np.asarray(r, dtype=np.int64) for r in got["x"]]
            new = learn({k: v.copy() for k, v in now.items()}, x, got["y"].to_numpy(dtype=np.int64), turn)
            return pd.DataFrame({"n": [len(got)], **{k: [new[k].astype(np.float32).tobytes()] for k in names}})

        return run

    for turn in range(rounds):
        models = dealt.groupBy("part").applyInPandas(part(params, turn), f"n long, {kinds}").collect()
        total = sum(m["n"] for m in models)
        if total:
            params = {
                k: sum(np.frombuffer(m[k], dtype=np.float32).reshape(v.shape) * (m["n"] / total) for m in models)
                for k, v in params.items()
            }
    return params
