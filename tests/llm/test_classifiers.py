"""Toxicity and quality: held-out accuracy, gradients, odd rows."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.llm import hashed, quality, toxicity

TABLES = "/root/testdata/sf0.1"


def held(i):
    return crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = entry.queries()["op9_toxicity"](spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.96
    assert np.mean([b for a, b in known if a == 0]) < 0.02


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = entry.queries()["op10_quality"](spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    known = [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(q == 1) == r.keep for (q, _), r in known]) > 0.93
    assert np.mean([r.keep for (q, t), r in known if q and not t]) > 0.99
    assert all(0 <= r.tail_prob <= 1 and r.tail_prob <= r.expected_grade <= 2 for _, r in known)


def slopes(loss, params, eps=1e-6):
    out = {}
    for k, v in params.items():
        g = np.zeros(v.shape)
        for at in np.ndindex(*v.shape):
            for sign in (1, -1):
                moved = {a: b.copy() for a, b in params.items()}
                moved[k][at] += sign * eps
                g[at] += sign * loss(moved) / (2 * eps)
        out[k] = g
    return out


class Recorder(hashed.Descent):
    seen = None

    def step(self, grads):
        Recorder.seen = grads


@pytest.mark.parametrize("module", [toxicity, quality])
def test_gradients(monkeypatch, module):
    rng = np.random.default_rng(1)
    vocab = np.arange(6) * 10
    x = [np.array(sorted(rng.choice(vocab, n, replace=False))) for n in (3, 0, 6, 2, 4)] + [np.array([5, 7])]
    at, starts = hashed.positions(vocab, x)
    if module is toxicity:
        y = np.array([0, 1, 1, 0, 1, 0])
        params = {"b": np.array([0.3]), "w": rng.normal(size=6), "v": rng.normal(size=(6, 2))}

        def loss(p):
            chance = toxicity.sigmoid(toxicity.margin(p, at, starts)[0])
            return -np.log(np.where(y == 1, chance, 1 - chance)).mean()
    else:
        y = np.array([0, 1, 2, 3, 1, 2])
        params = {"first": np.array([-1.0]), "gaps": rng.normal(size=2), "w": rng.normal(size=6)}

        def loss(p):
            f, t = hashed.sums(p["w"][at], starts), quality.thresholds(p)
            return -np.log(quality.below(t[y + 1] - f) - quality.below(t[y] - f)).mean()

    monkeypatch.setattr(module, "Descent", Recorder)
    module.learn(vocab, 1, {})({k: v.copy() for k, v in params.items()}, x, y, 0)
    for k, g in slopes(loss, params).items():
        assert np.allclose(Recorder.seen[k], g, atol=1e-5), k


def test_interactions_are_learnt():
    """Two terms that are harmless alone: only their product tells."""
    rng = random.Random(1)
    vocab = np.array([1, 2, 3, 4])
    x, y = [], []
    for _ in range(600):
        row = [t for t in (1, 2) if rng.random() < 0.5] + [t for t in (3, 4) if rng.random() < 0.5]
        x.append(np.array(row, dtype=np.int64))
        y.append(int(1 in row and 2 in row))
    params = {"b": np.zeros(1), "w": np.zeros(4), "v": np.random.default_rng(2).normal(0, 0.1, (4, 2))}
    for turn in range(8):
        params = toxicity.learn(vocab, 200, {"w": 3e-4, "v": 1e-5})(params, x, np.array(y), turn)
    at, starts = hashed.positions(vocab, x)
    assert ((toxicity.margin(params, at, starts)[0] > 0) == np.array(y)).mean() > 0.98
    assert abs(params["v"][0] @ params["v"][1]) > abs(params["v"][0] @ params["v"][2])


def test_odd_rows(spark):
    rng = random.Random(3)
    docs = [(i, ("vile " if i % 3 == 0 else "") + " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "x " * 60_000), (None, "w1 w2"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 0, 1.5) for d in docs], "doc_id long, text string, toxic int, score double")
    labels = [(i, None if i % 50 == 7 else int(i % 3 != 0), int(i % 3 == 0), 9) for i in range(300)]
    labels += [(999, 1, 1, 9), (None, 1, 1, 9), (4, 0, 0, 9), (6, None, None, 9)]
    graded = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, predicted int")
    for rows in (toxicity.toxicity(df, graded), quality.graded(df, graded)):
        got = rows.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in docs)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
        assert len({tuple(r) for r in got if r.doc_id == 0}) == 1
    wrong = sum(r.predicted != (r.doc_id % 3 == 0) for r in toxicity.toxicity(df, graded).collect() if r.doc_id in range(300))
    assert wrong <= 3
    none = graded.limit(0)
    assert {r.predicted for r in toxicity.toxicity(df, none).collect()} == {0}
    assert {r.keep for r in quality.graded(df, none).collect()} == {True}
    assert toxicity.toxicity(df.limit(0), graded).collect() == [] == quality.graded(df.limit(0), graded).collect()


def test_labels_without_documents_leave_the_sample_alone(spark):
    docs = spark.range(1_000, 1_100).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    all_of_them = hashed.labelled(docs, labels, F.col("y"), sample=3_000).collect()
    own = {r.id for r in hashed.labelled(docs, labels, F.col("y"), sample=40).collect()}
    assert len(own) == 40 and own < {r.id for r in all_of_them}
