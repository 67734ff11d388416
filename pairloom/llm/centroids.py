"""Lloyd's clustering of integer vectors with bounds that planar geometry tightens.

A vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound of
the distance to every other one. When centroid j moves from a to b by d, the lower bounds of
cluster i need not fall by d. All vectors of i lie in a sphere around i's centroid, and seen
from the middle of a and b, in the plane through a, b and that centroid, the sphere spans the
angles T - B to T + B from the direction of the move. A point at angle t has come nearer by
d * cos(t) at most: the points that came nearer by more than a given 2h lie inside a branch of
a hyperbola with foci a and b, which lies inside its asymptotes, whose angle has the cosine
2h / d. So the bounds of cluster i fall by d * cos(max(0, T - B)), nothing if that is negative,
and by d only where the sphere holds the middle. The largest fall over all j counts.

Vectors whose upper bound stays below the lower one keep their cluster; all others are scanned
exactly. Vectors are packed in blocks, in a table bucketed by block, and every round writes the
blocks' bounds in a table of the same buckets, so no round moves vectors between tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written
from pairloom.session import fresh_path

CLUSTERS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1_024, 64, "3"
BLOCK = 1_024  # vectors in a block
PART = 250_000  # vectors in a bucket, about
LARGEST = 1 << 27  # components of this size or more are left out: squared distances would not fit a long
SLACK = 1e-9  # relative, for rounding in bounds; all decisions are made on whole numbers
_STATE = np.dtype([("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")])


def whole(vec: np.ndarray | None, dim: int = DIM, scale: int = SCALE) -> np.ndarray | None:
    """The vector's floor(scale * x), or None where it has another length or components out of range."""
    if vec is None or len(vec) != dim:
        return None
    x = np.asarray(vec, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    v = np.floor(scale * x)
    return v.astype(np.int64) if (np.abs(v) < LARGEST).all() else None


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids)."""
    largest = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * v.shape[1] * int(largest) ** 2 < 1 << 52:  # then all sums are whole numbers that doubles hold
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        out = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
        return out.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def falls(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bounds of each cluster fall when all centroids move; ``radius`` is of its sphere."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    moved = np.linalg.norm(new - old, axis=1)
    out = np.zeros(len(old))
    for i, at in enumerate(old):
        for j in np.flatnonzero(moved):
            if j == i:
                continue
            to_center = at - (old[j] + new[j]) / 2
            far = np.linalg.norm(to_center)
            fall = moved[j]
            if far > radius[i] * (1 + SLACK):
                angle = np.arccos(np.clip(to_center @ (new[j] - old[j]) / (far * moved[j]), -1, 1))
                half = np.arcsin(np.clip(radius[i] * (1 + SLACK) / far, 0, 1))
                fall *= np.cos(max(0.0, angle - half - 1e-7))
            out[i] = max(out[i], fall * (1 + SLACK))
    return out


def assign(v: np.ndarray, state: np.ndarray | None, centroids: np.ndarray, moved: np.ndarray, fall: np.ndarray) -> np.ndarray:
    """The state of a block's vectors after the centroids moved; without a state all are scanned."""
    k = len(centroids)
    if state is None:
        out, scan = np.zeros(len(v), dtype=_STATE), np.arange(len(v))
    else:
        out = state.copy()
        out["upper"] += moved[out["cluster"]] * (1 + SLACK)
        out["lower"] -= fall[out["cluster"]]
        scan = np.flatnonzero(out["upper"] * (1 + SLACK) >= out["lower"])
        if len(scan):  # first with the exact distance to the own centroid
            own = np.sqrt(((v[scan] - centroids[out["cluster"][scan]]) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            out["upper"][scan] = own
            scan = scan[own * (1 + SLACK) >= out["lower"][scan]]
    if len(scan):
        far = squared(v[scan], centroids)
        best = far.argmin(axis=1)  # the smallest number of equal ones
        out["cluster"][scan] = best
        out["upper"][scan] = np.sqrt(far[np.arange(len(scan)), best].astype(np.float64)) * (1 + SLACK)
        far[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        out["lower"][scan] = np.sqrt(far.min(axis=1).astype(np.float64)) * (1 - SLACK) if k > 1 else np.inf
    return out


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """The rows from a table in the shared folder, bucketed by block. Its name leaves the catalog, its files stay."""
    spark = df.sparkSession
    table = f"pairloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", fresh_path(spark, name)).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> tuple[DataFrame, int]:
    """(block, ids, vectors, named) in buckets, and their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def block() -> pd.DataFrame:
            ids, own = zip(*held, strict=True)
            named = np.array([not pd.isna(i) for i in ids])
            return pd.DataFrame({
                "block": [part << 32 | n], "named": [named.tobytes()],
                "ids": [np.array([0 if pd.isna(i) else int(i) for i in ids], dtype="<i8").tobytes()],
                "vectors": [np.stack(own).astype("<i4").tobytes()],
            })

        for b in batches:
            for i, vec in zip(b["id"], b["vec"], strict=True):
                v = whole(vec, dim, scale)
                if v is not None:
                    held.append((i, v))
                    if len(held) == BLOCK:
                        yield block()
                        held, n = [], n + 1
        if held:
            yield block()

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.size("vec") == dim)
    per_task = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(per_task, -(-vectors.count() // PART))
    packed = rows.mapInPandas(run, "block long, ids binary, named binary, vectors binary")
    return _bucketed(packed.repartition(buckets, "block"), "blocks", buckets), buckets


def first_centroids(blocks: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:id``, fewer if there are fewer; equal ids by their vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, named, vectors in zip(b["ids"], b["named"], b["vectors"], strict=True):
                yield pd.DataFrame({
                    "id": pd.arrays.IntegerArray(np.frombuffer(ids, dtype="<i8").copy(), np.frombuffer(named, dtype="?") == 0),
                    "vector": list(np.frombuffer(vectors, dtype="<i4").reshape(-1, dim)),
                })

    rows = blocks.mapInPandas(run, "id long, vector array<int>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in first], dtype=np.int64).reshape(-1, dim)


def _round(
    blocks: DataFrame, state: DataFrame | None, buckets: int, dim: int, centroids: np.ndarray, moved: np.ndarray, fall: np.ndarray
) -> DataFrame:
    """(block, state, radius, counts, sums): new states, the largest upper bound of each cluster and what
    vectors that changed cluster add to counts and sums."""
    k = len(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, vectors, before in zip(b["block"], b["vectors"], b["state"], strict=True):
                v = np.frombuffer(vectors, dtype="<i4").reshape(-1, dim).astype(np.int64)
                old = None if before is None else np.frombuffer(before, dtype=_STATE)
                new = assign(v, old, centroids, moved, fall)
                radius, counts, sums = np.zeros(k), np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
                np.maximum.at(radius, new["cluster"], new["upper"])
                came = np.arange(len(v)) if old is None else np.flatnonzero(new["cluster"] != old["cluster"])
                for sign, of in ((1, new["cluster"][came]), *([] if old is None else [(-1, old["cluster"][came])])):
                    np.add.at(counts, of, sign)
                    np.add.at(sums, of, sign * v[came])
                yield pd.DataFrame({
                    "block": [block], "state": [new.tobytes()], "radius": [radius],
                    "change": [np.concatenate((counts, sums.ravel())) if len(came) else None],
                })

    rows = blocks.select("block", "vectors")
    if state is None:
        rows = rows.withColumn("state", F.lit(None).cast("binary"))
    else:
        rows = rows.join(state.select("block", "state").hint("merge"), "block")
    done = rows.mapInPandas(run, "block long, state binary, radius array<double>, change array<long>")
    return _bucketed(done, "bounds", buckets)


def _gathered(bounds: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[int]]:
    """Radius of each cluster, and counts and sums over all blocks: k * (dim + 2) numbers, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        radius, change = np.zeros(k), np.zeros(k * (dim + 1), dtype=np.int64)
        for b in batches:
            for own in b["radius"]:
                radius = np.maximum(radius, own)
            for own in b["change"].dropna():
                change += own
        yield pd.DataFrame({
            "at": np.arange(k * (dim + 1)), "n": change, "radius": np.concatenate((radius, np.zeros(k * dim))),
        })

    parts = bounds.select("radius", "change").mapInPandas(run, "at int, n long, radius double")
    rows = parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.max("radius").alias("radius")).collect()
    rows.sort(key=lambda r: r["at"])
    return np.array([r["radius"] for r in rows[:k]]), [int(r["n"]) for r in rows]


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dim: int = DIM, scale: int = SCALE, seed: str = SEED, watch: Callable[[int, np.ndarray, np.ndarray], None] | None = None,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that counts.

    A vector counts if it has exactly ``dim`` components, all finite; it stands for the whole
    numbers floor(scale * x). Vectors with a number of LARGEST or more in size are left out, as
    their squared distances would not fit a long. Ids may be null (their hash is of the empty
    id) and may repeat; equal rows stay. With fewer than ``k`` vectors there are as many
    clusters as vectors. Empty clusters keep their centroid. An empty table, or one without
    such vectors, gives an empty result; other columns are not read. ``watch`` is called after
    every round with its number, the falls of the lower bounds and the moves of the centroids.
    """
    spark = vectors.sparkSession
    blocks, buckets = _blocks(vectors, id_col, vec_col, dim, scale)
    centroids = first_centroids(blocks, k, dim, seed)
    k = len(centroids)
    schema = "id long, cluster int, distance long"
    if not k:
        out = spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return out.withColumnRenamed("id", id_col)
    state, total, moved, fall = None, [0] * (k * (dim + 1)), np.zeros(k), np.zeros(k)
    for n in range(rounds):
        state = _round(blocks, state, buckets, dim, centroids, moved, fall)
        radius, change = _gathered(state, k, dim)
        total = [a + b for a, b in zip(total, change, strict=True)]
        new = centroids.copy()
        for i in range(k):
            if total[i]:
                new[i] = [s // total[i] for s in total[k + i * dim:k + (i + 1) * dim]]
        moved, fall = np.linalg.norm((new - centroids).astype(np.float64), axis=1), falls(centroids, new, radius)
        centroids = new
        if watch:
            watch(n, fall, moved)
    state = _round(blocks, state, buckets, dim, centroids, moved, fall)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, named, vectors, state in zip(b["ids"], b["named"], b["vectors"], b["state"], strict=True):
                v = np.frombuffer(vectors, dtype="<i4").reshape(-1, dim).astype(np.int64)
                own = np.frombuffer(state, dtype=_STATE)["cluster"]
                yield pd.DataFrame({
                    "id": pd.arrays.IntegerArray(np.frombuffer(ids, dtype="<i8").copy(), np.frombuffer(named, dtype="?") == 0),
                    "cluster": own, "distance": ((v - centroids[own]) ** 2).sum(axis=1),
                })

    found = written(blocks.join(state.select("block", "state").hint("merge"), "block").mapInPandas(last, schema), "clustered")
    sums = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digests = spark.createDataFrame(
        [(i, n, sum(sums.values()), ",".join(map(str, centroids[i].tolist()))) for i, n in sums.items()],
        "cluster int, cluster_inertia long, inertia long, spelt string",
    ).withColumn("centroid_sha256", F.sha2("spelt", 256)).drop("spelt")
    return found.join(F.broadcast(digests), "cluster").select(  # a row for each of the k clusters
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    )
