"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import hashed
from pairloom.llm.hashed import Descent, Params, positions, sums

FACTORS = 4
LEAST_ROWS, MOST_TERMS = 10, 1 << 17
CHOOSE, FIT = (1, 15), (2, 60)  # rounds and steps of each: to choose terms, to fit the chosen
RATE, L1, CALM = {"b": 0.1, "w": 0.3, "v": 0.02}, {"w": 0.003, "v": 1e-3}, {"v": 1e-2}
BLOCK = 200_000  # terms of rows whose slopes are computed at once
LIVE = 0.1  # weight or length of a factor that keeps a term


def margin(p: Params, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each row, and its factor sums.

    Bias + sum of weights + sum over pairs of terms of the product of their factors.
    """
    v = p["v"][at]
    total = sums(v, starts)
    pairs = (total**2 - sums(v**2, starts)).sum(axis=1) / 2
    return p["b"][0] + sums(p["w"][at], starts) + pairs, total


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chosen(vocab: np.ndarray, p: Params) -> tuple[np.ndarray, Params]:
    """The terms of some weight or with a long factor."""
    live = (np.abs(p["w"]) > LIVE) | (np.linalg.norm(p["v"], axis=1) > LIVE)
    return vocab[live], {"b": p["b"], "w": p["w"][live], "v": p["v"][live]}


def learn(vocab: np.ndarray, steps: int, l1: dict[str, float]):
    def run(params: Params, x: list[np.ndarray], y: np.ndarray, turn: int) -> Params:
        descent = Descent(params, RATE, l1, CALM)
        at, starts = positions(vocab, x)
        edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(at), BLOCK)), len(y)))
        for _ in range(steps):
            grads = {k: np.zeros(v.shape) for k, v in descent.params.items()}
            for lo, hi in zip(np.append(0, edges[:-1]), edges, strict=True):
                own, of = at[starts[lo]:starts[hi]], starts[lo:hi + 1] - starts[lo]
                z, total = margin(descent.params, own, of)
                error = (sigmoid(z) - y[lo:hi]) / len(y)
                size = np.diff(of)
                each = np.repeat(error, size)
                pull = each[:, None] * (np.repeat(total, size, axis=0) - descent.params["v"][own])
                grads["b"] += error.sum()
                grads["w"] += np.bincount(own, each, len(vocab))
                grads["v"] += np.stack([np.bincount(own, c, len(vocab)) for c in pull.T], axis=1)
            descent.step(grads)
        return descent.params

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample: int = hashed.SAMPLE) -> tuple[np.ndarray, Params]:
    """Vocabulary and parameters, learnt from at most ``sample`` labelled rows that are not held out."""
    rows = hashed.labelled(docs, labels, F.col(label), id_col, text_col, sample=sample, name="toxic_rows")
    vocab = hashed.vocabulary(rows, LEAST_ROWS, MOST_TERMS)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (ones + 0.5) / (n + 2)
    rng = np.random.default_rng(42)
    params = {"b": np.array([np.log(prior / (1 - prior))]), "w": np.zeros(len(vocab)),
              "v": rng.normal(0, 0.02, (len(vocab), FACTORS))}
    params = hashed.average(rows, params, learn(vocab, CHOOSE[1], L1), CHOOSE[0])
    vocab, params = chosen(vocab, params)
    return vocab, hashed.average(rows, params, learn(vocab, FIT[1], L1 | {"w": L1["w"] / 10}), FIT[0])


def score(text: Column, vocab: np.ndarray, params: Params) -> Column:
    """Toxicity of a text, 0 to 1. Null and empty texts have no terms and score by the bias alone."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        found = [margin(params, at, starts)[0] for at, starts in hashed.held_positions(vocab, texts)]
        return pd.Series(sigmoid(np.concatenate(found)))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label: str = "toxic", sample: int = hashed.SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Labels of held-out ids (CRC of the id as text divisible by 5) are never read. Labels of
    unknown documents and null labels count for nothing; without any label the score is the
    prior 0.25. Null and empty texts have no terms and score by the bias alone. Repeated rows
    are scored alike. An empty table gives an empty result; only id
    and text are read.
    """
    vocab, params = fit(docs, labels, label, id_col, text_col, sample)
    scored = docs.select(
        id_col, hashed.held_out(id_col).alias("held_out"), score(F.col(text_col), vocab, params).alias("score")
    )
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
