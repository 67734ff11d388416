"""Benchmark passages in documents, found by latent semantic retrieval and verified word by word.

The index is the benchmark: its passages as TF-IDF rows, with document frequencies from all
documents, and the leading right singular vectors of these rows from a randomised SVD, whose
products with the rows run as Spark jobs. Overlapping windows of every document that hold a key
of some passage are folded in and compared with all passages by cosine. Keys lose nothing: if a
share s of m words is needed, (1 - s) m may be missing, so one of any (1 - s) m + 1 is there; the
rarest are the keys. RANK vectors don't span all passages of a block, so a passage with a key in
a window is a candidate whatever its cosine. Candidates whose words are there are settled by
the longest common subsequence: SAME of a passage, or CLOSE of it where its answer stands there
too. Items of fewer than SHORT words have to stand there as they are.

A benchmark is searched in blocks of BLOCK passages; each reads the documents twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import in_parts, written

MARKS = b".,;:!?\"'()[]{}"
LONGEST, SHORT = 64, 5  # words of an index passage: longer items are cut, shorter ones are phrases
WINDOW, STRIDE = 32, 16
BLOCK, RANK, EXTRA, POWERS = 1_024, 256, 16, 2
COSINE, SAME, CLOSE = 0.4, 0.8, 0.5
TERMS = 2_048  # terms whose products are summed in one group
_STACK, _PAIRS = 64, 4_096  # windows and candidates that are compared at once


def plain_words(text: str | None) -> list[bytes]:
    """Words without marks, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, MARKS).split()


def common_length(masks: dict[bytes, int], size: int, said: list[bytes]) -> int:
    """Length of the longest common subsequence of a passage, given as masks of its words' places, and a text."""
    full = (1 << size) - 1
    row = full
    for w in said:
        at = row & masks.get(w, 0)
        row = (row + at | row - at) & full
    return size - row.bit_count()


@dataclass
class Passage:
    item: int | None
    words: list[bytes]
    answer: bytes | None

    def __post_init__(self) -> None:
        self.masks: dict[bytes, int] = {}
        for k, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << k

    def least(self) -> int:
        """How many of its words a text must hold."""
        size = len(self.words)
        return size if size < SHORT else math.ceil((CLOSE if self.answer else SAME) * size - 1e-9)

    def similarity(self, said: list[bytes]) -> float:
        """Share of the passage found in order; zero unless that is enough."""
        if len(self.words) < SHORT:
            return float(b" %b " % b" ".join(self.words) in b" %b " % b" ".join(said))
        held = set(said)
        most = sum(w in held for w in self.words) / len(self.words)
        if most < (CLOSE if self.answer else SAME):  # the subsequence is no longer than that
            return 0.0
        share = common_length(self.masks, len(self.words), said) / len(self.words)
        if share >= SAME or (share >= CLOSE and self.answer and b" %b " % self.answer in b" %b " % b" ".join(said)):
            return share
        return 0.0


def cut(items: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """(n, item, words, answer): passages of at most LONGEST words, numbered from 0 within blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, answer in zip(b["item"].astype("Int64"), b["text"], b["answer"], strict=True):
                w = plain_words(text)
                parts = -(-len(w) // LONGEST)
                for k in range(parts):
                    part = w[k * len(w) // parts:(k + 1) * len(w) // parts]
                    out.append((i, part, b" ".join(plain_words(answer)) or None))
            yield pd.DataFrame(out, columns=["item", "words", "answer"]).astype({"item": "Int64"})

    answer = F.col(answer_col) if answer_col else F.lit(None)
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"),
                        answer.cast("string").alias("answer"))
    return rows.mapInPandas(run, "item long, words array<binary>, answer binary").distinct()


def blocks(passages: DataFrame) -> Iterator[DataFrame]:
    """The passages in hash parts of about BLOCK."""
    n = passages.count()
    parts = -(-n * 5 // (BLOCK * 4))
    for k in range(parts):
        yield passages.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k)


def frequencies(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), dtype=np.int64)
        for b in batches:
            for text in b["text"]:
                found = [terms[w] for w in terms.keys() & set(plain_words(text))]
                total[found] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    counts = docs.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), dtype=np.int64)
    for r in counts.collect():
        out[r["term"]] = r["n"]
    return out


def basis(rows: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF rows, by randomised subspace iteration.

    ``rows`` has the array column ``at`` of term numbers. A round multiplies the vectors by
    A'A: every part of the rows by its own products, whose sums are the result.
    """
    size = len(weights)
    rng = np.random.default_rng(7)

    def gram(v: np.ndarray, small: bool) -> np.ndarray:
        shape = (v.shape[1], v.shape[1]) if small else v.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(shape)
            for b in batches:
                for at in b["at"]:
                    a = weights[at]
                    y = a @ v[at]
                    if small:
                        total += np.outer(y, y)
                    else:
                        np.add.at(total, at, np.outer(a, y))
            for first in range(0, shape[0], TERMS):
                yield pd.DataFrame({"first": [first], "part": [total[first:first + TERMS].tobytes()]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p) for p in parts["part"])
            return pd.DataFrame({"first": parts["first"][:1], "part": [total.tobytes()]})

        kinds, out = "first long, part binary", np.zeros(shape)
        for r in rows.mapInPandas(run, kinds).groupBy("first").applyInPandas(add, kinds).toLocalIterator():
            out[r["first"]:r["first"] + TERMS] = np.frombuffer(r["part"]).reshape(-1, shape[1])
        return out

    v = np.linalg.qr(rng.normal(size=(size, min(rank + EXTRA, size))))[0]
    for _ in range(POWERS):
        v = np.linalg.qr(gram(v, small=False))[0]
    power, turn = np.linalg.eigh(gram(v, small=True))
    keep = power > power.max(initial=0.0) * 1e-12
    return (v @ turn[:, keep])[:, ::-1][:, :rank].astype(np.float32)


@dataclass
class Index:
    """What a task needs to search for a block of passages."""

    passages: list[Passage]
    terms: dict[bytes, int]
    keys: list[list[int]]  # of each passage: its rarest terms, one of which a text that shows it holds
    weights: np.ndarray  # of each term
    folded: np.ndarray  # weighted basis row of each term, and zeros for no term
    places: np.ndarray  # passages in the latent space, unit length

    def __post_init__(self) -> None:
        """Postings: the passages that have a term among their keys."""
        pairs = sorted((t, k) for k, keys in enumerate(self.keys) for t in keys)
        self.posted = np.array([k for _, k in pairs], dtype=np.int64)
        self.first = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 2))
        self.keyed = np.append(np.diff(self.first)[:-1] > 0, False)  # of each term, and of no term
        self.spelt = np.full((len(self.passages), LONGEST), -1)  # terms of each passage, and no term
        for k, p in enumerate(self.passages):
            self.spelt[k, :len(p.words)] = [self.terms[w] for w in p.words]
        self.sizes = np.array([len(p.words) for p in self.passages])
        self.least = np.array([p.least() for p in self.passages])

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of windows, in order, and the passages that they hold a key of."""
        n = max(-(-(len(at) - STRIDE) // STRIDE), 1)
        hits = np.flatnonzero(self.keyed[at])
        term = at[hits]
        size = self.first[term + 1] - self.first[term]
        ends = np.cumsum(size)
        passage = self.posted[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[term] - ends + size, size)]
        last = np.repeat(hits // STRIDE, size)
        window = np.concatenate((last, last - 1))
        both = np.tile(passage, 2) + window * len(self.passages)
        both = np.unique(both[(window >= 0) & (window < n)])
        return both // len(self.passages) * STRIDE, both % len(self.passages)

    def near(self, at: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words of the windows at ``starts``, and passages that are close to them by cosine."""
        padded = np.concatenate((at, np.full(WINDOW, -1)))
        for s in range(0, len(starts), _STACK):
            first = starts[s:s + _STACK]
            place = self.folded[padded[first[:, None] + np.arange(WINDOW)]].sum(axis=1)
            place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12)
            window, passage = np.nonzero(place @ self.places.T >= COSINE)
            yield first[window], passage

    def search(self, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Candidates (first word of the window, passage) with enough of the passage's words around the window."""
        first, passage = self.windows(at)
        found = [(first, passage), *self.near(at, np.unique(first))]
        first, passage = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(first * len(self.passages) + passage)
        room = len(at) + 1
        spots = np.sort(at * room + np.arange(len(at)))  # of terms, each in order; of no term before them
        spots = np.append(spots, np.iinfo(np.int64).max)
        for s in range(0, len(pairs), _PAIRS):
            first, passage = np.divmod(pairs[s:s + _PAIRS], len(self.passages))
            own, size = self.spelt[passage], self.sizes[passage]
            since = own * room + np.maximum(first - size, 0)[:, None]
            until = own * room + np.minimum(first + WINDOW + size, len(at))[:, None]
            held = (spots[np.searchsorted(spots, since)] < until) & (own >= 0)
            enough = held.sum(axis=1) >= self.least[passage]
            yield from zip(first[enough].tolist(), passage[enough].tolist(), strict=True)

    def matches(self, text: str | None) -> dict[int, tuple[float, int]]:
        """Items in a text: similarity and first word of the window that showed it."""
        said, best = plain_words(text), {}
        get = self.terms.get
        at = np.fromiter(map(get, said, repeat(-1)), dtype=np.int64, count=len(said))
        if not self.keyed[at].any():
            return best
        for first, p in self.search(at):
            passage = self.passages[p]
            margin = len(passage.words)
            found = passage.similarity(said[max(0, first - margin):first + WINDOW + margin])
            if found > best.get(passage.item, (0.0, 0))[0]:
                best[passage.item] = (found, first)
        return best


def index(docs: DataFrame, block: DataFrame, n_docs: int) -> Index | None:
    block = written(block, "passages")
    passages = [Passage(r["item"], list(map(bytes, r["words"])), r["answer"] and bytes(r["answer"])) for r in block.collect()]
    if not passages:
        return None
    passages.sort(key=lambda p: (p.item is None, p.item or 0, p.words))
    terms = {w: k for k, w in enumerate(sorted({w for p in passages for w in p.words}))}
    n = frequencies(docs, terms)
    weights = np.log((n_docs + 1) / (n + 1)) + 1e-3
    keys = []
    for p in passages:
        own = sorted((terms[w] for w in p.words), key=lambda t: (n[t], t))
        keys.append(sorted(set(own[:len(own) - p.least() + 1])))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"at": [[terms[bytes(w)] for w in words] for words in b["words"]]})

    v = basis(written(block.mapInPandas(numbered, "at array<long>"), "passage_terms").coalesce(8), weights)
    folded = np.vstack([v * weights[:, None], np.zeros((1, v.shape[1]))]).astype(np.float32)
    places = np.stack([folded[[terms[w] for w in p.words]].sum(axis=0) for p in passages])
    places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-12)
    return Index(passages, terms, keys, weights, folded, places)


def indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, answer_col: str | None) -> Iterator[Broadcast]:
    """A broadcast index for each block of passages; its size is bounded by BLOCK and LONGEST."""
    passages = written(in_parts(cut(benchmark, item_col, item_text, answer_col), benchmark.count(), BLOCK), "benchmark_passages")
    n_docs = docs.count()
    for block in blocks(passages) if n_docs else ():
        own = index(docs, block, n_docs)
        if own is not None:
            yield docs.sparkSession.sparkContext.broadcast(own)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item_id, similarity, first_word): the benchmark items that each document holds.

    ``similarity`` is the share of the item (of its best passage, if it is longer than LONGEST
    words) that the document has in order near ``first_word``. Documents and items are whole;
    a document without items has no row. Null and empty texts and items hold nothing, items of
    fewer than SHORT words are found as phrases, equal items are found each. Rows that share an
    id (also null) are reported once, with the best similarity, and so are items. An empty table on
    either side gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, similarity double, first_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in indexes(rows, benchmark, item_col, item_text, answer_col):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [
                    (None if pd.isna(i) else int(i), item, share, first) for i, text in zip(b["id"], b["text"], strict=True)
                    for item, (share, first) in shared.value.matches(text).items()
                ]
                if out:
                    got = pd.DataFrame(out, columns=["id", "item", "similarity", "first_word"])
                    yield got.astype({"id": "Int64", "item": "Int64"})

        found = found.unionByName(rows.mapInPandas(run, schema))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("best")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias(id_col), F.col("item").alias("item_id"), "best.similarity",
        (-F.col("best.back")).alias("first_word"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are; otherwise as ``leaks``."""

    def holds(shared: Broadcast):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.matches(t)) for t in texts], dtype=bool)

        return run(F.col(text_col))

    kept = docs
    for shared in indexes(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text, answer_col):
        kept = kept.where(~holds(shared))
    return kept
