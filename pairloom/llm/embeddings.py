"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Equal vectors are one class. Unit vectors are projected on random lines. Two lines deal them
into cells, and a vector also visits the cells within REACH of its place, so that pairs meet
once. In a cell every other line is sorted, each vector counts who lies in the window around
its own place, and pairs that collide on enough lines are verified by their cosine.

Two vectors of cosine c differ on a line by a normal variable of deviation sqrt(2 - 2c). The
count a pair needs is the largest that a pair right at the threshold reaches with the chance
RECALL. Work grows with the square of the vectors in one cell of one label.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written
from pairloom.llm.components import components

COSINE = 0.98
LINES, RECALL, SEED = 16, 0.999, 42
CELL, DEVIATIONS, WINDOW = 4.0, 3.2, 2.0  # side, reach and half a window, in deviations at the threshold
CHUNK = 2_048  # vectors of a cell that are compared in one piece
_COUNTS = 1 << 22  # pair counters held at once


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, LINES + 2))


def least_count(window: float = WINDOW, n: int = LINES, recall: float = RECALL) -> int:
    p = erf(window / sqrt(2))
    at_least, c = 0.0, n + 1
    while at_least < recall:
        c -= 1
        at_least += comb(n, c) * p**c * (1 - p) ** (n - c)
    return c


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        raw = []
        for i, label, v in zip(b["id"], b["label"], b["vec"], strict=True):
            v = None if v is None or pd.isna(i) or pd.isna(label) else np.asarray(v, dtype=np.float64) + 0.0
            raw.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
        yield pd.DataFrame({"id": b["id"], "label": b["label"], "raw": raw})


def _deal(deviation: float):
    side, reach = CELL * deviation, DEVIATIONS * deviation

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, raw in enumerate(b["raw"]):
                v = np.frombuffer(raw)
                at = (v / np.linalg.norm(v)) @ lines(len(v))[:, :2]
                home = tuple(np.floor(at / side).astype(int))
                first, last = np.floor((at - reach) / side).astype(int), np.floor((at + reach) / side).astype(int)
                rows += [
                    (i, x, y, (x, y) != home) for x in range(first[0], last[0] + 1) for y in range(first[1], last[1] + 1)
                    if (x, y) >= home
                ]
            if rows:
                of, x, y, guest = zip(*rows, strict=True)
                out = b.iloc[list(of)].reset_index(drop=True)
                yield out.assign(dim=out["raw"].str.len() // 8, x=x, y=y, guest=guest)

    return run


def candidates(places: np.ndarray, guest: np.ndarray, window: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, host) of rows whose places collide on at least ``least`` lines."""
    hosts, n = np.flatnonzero(~guest), len(places)
    if not len(hosts):
        return
    order = [hosts[np.argsort(places[hosts, k], kind="stable")] for k in range(places.shape[1])]
    block = max(1, _COUNTS // n)
    for start in range(0, n, block):
        q = np.arange(start, min(n, start + block))
        counts = np.zeros(len(q) * n, dtype=np.int64)
        for k, by_place in enumerate(order):
            sorted_places = places[by_place, k]
            lo = np.searchsorted(sorted_places, places[q, k] - window, "left")
            hi = np.searchsorted(sorted_places, places[q, k] + window, "right")
            size = hi - lo
            ends = np.cumsum(size)
            within = np.arange(ends[-1]) + np.repeat(lo - ends + size, size)
            counts += np.bincount(np.repeat((q - start) * n, size) + by_place[within], minlength=len(counts))
        a, b = np.divmod(np.flatnonzero(counts >= least), n)
        yield a + start, b


def _compare(deviation: float, cosine: float):
    window, least = WINDOW * deviation, least_count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(r) for r in pdf["raw"]])
        norm = np.linalg.norm(v, axis=1)
        places = (v / norm[:, None]) @ lines(v.shape[1])[:, 2:]
        guest, chunk = pdf["guest"].to_numpy(dtype=bool), pdf["chunk"].to_numpy()
        across = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        n, node = pdf["n"].to_numpy(), pdf["node"].to_numpy()
        add, root = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
        for a, b in candidates(places, guest, window, least):
            # hosts meet each other from both sides, a guest meets a host from its own side only
            once = (guest[a] | (a < b)) & (~across | (chunk[a] != chunk[b]))
            a, b = a[once], b[once]
            close = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b]) >= cosine
            a, b = a[close], b[close]
            add += np.bincount(a, n[b], len(pdf)).astype(np.int64) + np.bincount(b, n[a], len(pdf)).astype(np.int64)
            while (root[a] != root[b]).any():
                least_root = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], least_root)
                np.minimum.at(root, root[b], least_root)
                root = root[root]
        linked = add > 0
        return pd.DataFrame({"node": node[linked], "other": node[root[linked]], "add": add[linked]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors have the same length and
    the cosine is ``cosine`` or more. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id that links reach, ``kept`` is id = component_id. Rows
    with null id, label or vector, zero vectors and those with null or non-finite components
    link with nothing. Repeated rows link with each other; rows of one id with different
    vectors are one node of the links. An empty table gives an empty result; other columns
    are not read.
    """
    deviation = sqrt(2 - 2 * cosine)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    rows = written(rows.mapInPandas(_parse, "id long, label string, raw binary"), "vectors")
    classes = rows.where("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    classes = written(classes, "vector_classes")
    cell = ["label", "dim", "x", "y"]
    dealt = classes.mapInPandas(
        _deal(deviation), "label string, raw binary, node long, n long, dim long, x long, y long, guest boolean"
    )
    large = written(dealt.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > chunk), "large_cells")
    whole = dealt.select("*", F.lit(0).alias("chunk"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    if not large.isEmpty():
        parts = F.ceil(F.col("size") / chunk).cast("int")
        own = F.pmod(F.xxhash64("node", "raw"), parts).cast("int")
        split = dealt.join(large, cell).select(
            *dealt.columns, own.alias("chunk"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
        ).select(
            *dealt.columns, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
        )
        whole = whole.join(large, cell, "left_anti").unionByName(split)
    found = whole.groupBy(*cell, "lo", "hi").applyInPandas(_compare(deviation, cosine), "node long, other long, add long")
    found = written(found, "vector_links")
    roots = components(found, "node", "other")
    added = found.groupBy("node").agg(F.sum("add").alias("added"))
    classes = classes.join(added, "node", "left").join(roots, "node", "left").select(
        "label", "raw", (F.col("n") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    out = rows.join(classes, ["label", "raw"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
