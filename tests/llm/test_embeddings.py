"""Embedding near-duplicates against brute force."""

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pairloom.llm import embeddings
from tests.conftest import SMALL


def plain(rows, cosine=0.98):
    """(id, n_links, component, kept) of every row."""
    n = len(rows)
    ok = [
        i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)
        for i, v, label in rows
    ]
    links = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x.tobytes() == y.tobytes() or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = rows[a][0] if not ok[a] else min(rows[i][0] for i in seen)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] is not None and rows[a][0] == least))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    wanted = plain([(r["vec_id"], r["embedding"], r["label"]) for r in t])
    got = entry.queries()["op6_embedding_near_dedup"](spark, SMALL)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == wanted


def test_odd_rows_and_large_cells(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in base[k % 12] + rng.normal(scale=0.02, size=16)], k % 2) for k in range(90)]
    rows += [(200 + k, [float(x) for x in base[0]], 0) for k in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0),
             (304, [1.0] * 16, None), (305, [float(x) for x in base[0][:8]], 0), (None, [1.0] * 16, 0), (306, [], 0)]
    rows += rows[:5] + [(307, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, n int, raw int")
    wanted = plain(rows)
    for chunk in (2_048, 20):
        got = embeddings.near_duplicates(df, chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == wanted
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    gap = (x - (0.9801 * x + np.sqrt(1 - 0.9801**2) * side)) @ embeddings.lines(64)
    met = (np.abs(gap[:, :2]) <= embeddings.DEVIATIONS * 0.2).all(axis=1)
    collide = (np.abs(gap[:, 2:]) <= embeddings.WINDOW * 0.2).sum(axis=1) >= embeddings.least_count()
    assert (met & collide).mean() > 0.985
