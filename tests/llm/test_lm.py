"""Language-model scores: counts against brute force, proper distributions, held-out gain."""

import random
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

import __spark_entry__ as entry
from pairloom.llm import lm

TABLES = "/root/testdata/sf0.01"


def plain(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) of (id, text) rows."""
    tokens = [[*(t or "").encode().lower().split(), lm.END] for _, t in rows]
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for said, out in zip(tokens, held, strict=True) if not out for w in said)
    n = sum(c.values())
    return [
        (i, out, len(said), sum(w in c for w in said), n, sum(log10((c[w] + 1) / (n + len(c) + 1)) for w in said))
        for (i, _), said, out in zip(rows, tokens, held, strict=True)
    ]


def same(got, rows):
    wanted = sorted(plain(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-9)


def test_query(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op3_lm_scores"](spark, TABLES).collect()
    same(got, docs)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("common", [3, 1 << 17])
def test_odd_rows(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "w1 É é"), rows[0], rows[0], (202, "a\xa0b \x1c c"), (203, "x " * 250_000)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, key int, score double")
    same(lm.scores(df).collect(), rows)
    assert lm.scores(df.limit(0)).collect() == []
    alone = df.where("doc_id = 2 OR doc_id = 11").where("crc32(CAST(doc_id AS STRING)) % 7 = 2")
    same(lm.scores(alone).collect(), [(r.doc_id, r.text) for r in alone.collect()])


def test_distribution_and_gradient():
    rng = np.random.default_rng(1)
    texts = ["the cat sat", "", "the dog sat on the cat"]
    (lexicon, numbers, starts), = lm.pieces(iter(texts))
    classes = lexicon.classes()
    rows, said = lm.features(lexicon, classes, numbers, starts), classes[numbers]
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES))
    p = lm.chances(weights, rows)
    assert np.allclose(p.sum(axis=1), 1)
    assert (rows[0][starts[:-1]] == 1 + lm.CLASSES).all()  # nothing stands before a text
    assert rows[2][2] == 1 + 2 * (lm.CLASSES + 1) + lm.CLASSES

    def loss(w):
        return -np.log(lm.chances(w, rows)[np.arange(len(said)), said]).sum()

    squares, moved = np.zeros(weights.shape), weights.copy()
    lm.step(moved, squares, rows, said)
    for at in [(0, 3), (rows[0][1], said[1]), (rows[4][2], said[2]), (rows[3][1], said[1])]:
        up, down = weights.copy(), weights.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert np.isclose((loss(up) - loss(down)) / 2e-5, np.sign(weights[at] - moved[at]) * np.sqrt(squares[at]), atol=1e-3)
