"""Clustering against plain Lloyd rounds, and the bounds against the distances they bound."""

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pairloom.llm import centroids
from tests.conftest import SMALL


def plain(rows, k=8, rounds=10, dim=64, scale=1024):
    """Sorted result rows of (id, vector) rows, all distances computed."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v]))
    if not kept:
        return []
    own = np.array([v for _, v in kept], dtype=object)
    order = sorted(range(len(kept)), key=lambda n: (
        hashlib.sha256(f"3:{'' if kept[n][0] is None else kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    c = own[order[:k]]

    def nearest():
        far = np.stack([((own - x) ** 2).sum(axis=1) for x in c], axis=1)
        at = [min(range(len(c)), key=lambda j: (f[j], j)) for f in far]
        return at, [f[j] for f, j in zip(far, at)]

    for _ in range(rounds):
        at = np.array(nearest()[0])
        c = np.array([[s // int((at == j).sum()) for s in own[at == j].sum(axis=0)] if (at == j).any() else c[j] for j in range(len(c))], dtype=object)
    at, far = nearest()
    inertia = {j: sum(d for a, d in zip(at, far) if a == j) for j in set(at)}
    spelt = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, inertia[j], sum(far), spelt[j]) for (i, _), j, d in zip(kept, at, far)), key=str)


def test_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = entry.queries()["op11_centroid_clusters"](spark, SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint",
                                "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("spread", [0.3, 40.0])
def test_clouds_ties_and_odd_rows(spark, monkeypatch, spread):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = np.random.default_rng(3)
    places = rng.normal(size=(12, 64)) * 3
    rows = [(int(i), (places[rng.integers(12)] + rng.normal(size=64) * spread).tolist()) for i in rng.permutation(700)]
    rows += [(1_000 + k, [float(k % 3)] * 64) for k in range(60)]  # copies and ties
    rows += [(None, rows[0][1]), (7, rows[1][1]), rows[2], rows[2], (8_000, None), (8_001, []), (8_002, [1.0] * 63),
             (8_003, [math.nan] * 64), (8_004, [None] * 64), (8_005, [math.inf] * 64)]
    df = spark.createDataFrame([(1, i, v, 2) for i, v in rows], "cluster int, vec_id long, embedding array<double>, block int")
    falls, moves = [], []
    got = centroids.cluster(df.repartition(3), watch=lambda n, fall, moved: (falls.append(fall), moves.append(moved)))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert len(falls) == 10 and np.sum(falls) < np.sum([[m.max()] * 8 for m in moves])
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, centroids.cluster(few).collect()), key=str) == plain([r for r in rows if r[0] is not None and r[0] < 5])
    for none in (df.limit(0), df.where("vec_id >= 8000")):
        assert centroids.cluster(none).collect() == []
    big = spark.createDataFrame([(1, [131_072.0] * 64), (2, [131_071.0] * 64), (3, [-131_071.0] * 64)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.cluster_inertia for r in centroids.cluster(big).collect()} == {2: 0, 3: 0}


def test_no_round_shuffles_vectors(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.normal(size=64).tolist()) for k in range(200)], "vec_id long, embedding array<double>")
    blocks, buckets = centroids._blocks(df, "vec_id", "embedding", 64, 1_024)
    c = centroids.first_centroids(blocks, 8, 64, "3")
    state = centroids._round(blocks, None, buckets, 64, c, np.zeros(8), np.zeros(8))
    joined = blocks.join(state.select("block", "state").hint("merge"), "block")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_falls_bound_every_point_of_the_sphere():
    rng = np.random.default_rng(5)
    smaller = 0
    for dim in (2, 3, 10):
        for _ in range(300):
            old = rng.integers(-1_000, 1_000, (3, dim))
            new = old + rng.integers(-1, 2, (3, dim)) * rng.integers(0, 400, (3, 1))
            radius = rng.uniform(0, 900, 3)
            fall = centroids.falls(old, new, radius)
            for i in range(3):
                way = rng.normal(size=(400, dim))
                way *= (radius[i] * rng.uniform(0, 1, 400) ** (1 / dim) / np.linalg.norm(way, axis=1))[:, None]
                x = old[i] + way
                for j in range(3):
                    if j != i:
                        near = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                        assert near.max() <= fall[i] + 1e-6
                others = [np.linalg.norm(new[j] - old[j]) for j in range(3) if j != i]
                assert fall[i] <= max(others) * (1 + 1e-6)
                smaller += fall[i] < 0.9 * max(others)
    assert smaller > 500


def test_far_numbers_are_exact():
    rng = random.Random(1)
    v = np.array([[rng.randrange(-2**27 + 1, 2**27) for _ in range(64)] for _ in range(5)])
    got = centroids.squared(v, v)
    assert got.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in v] for x in v]
