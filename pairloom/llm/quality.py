"""Quality grades: ordinal regression with a cumulative link over hashed terms.

P(grade <= j) = sigmoid(threshold j - sum of the weights of a text's terms). All grades share
the weights; the thresholds are ordered because their gaps are exponentials.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import hashed
from pairloom.llm.hashed import Descent, Params, positions, sums
from pairloom.llm.toxicity import sigmoid

LEAST_ROWS, MOST_TERMS = 10, 1 << 17
CHOOSE, FIT = (1, 25), (2, 80)  # rounds and steps of each: to choose terms, to fit the chosen
RATE, L1 = {"first": 0.1, "gaps": 0.1, "w": 0.3}, {"w": 0.003}
LIVE = 0.1  # weight that keeps a term


def grade_of(quality: Column, toxic: Column) -> Column:
    """Ratings of the labels: 0 junk, 1 well formed but toxic, 2 well formed and clean."""
    return F.when(quality == 0, 0).when(quality.isNotNull(), F.when(toxic == 1, 1).otherwise(2))


def thresholds(p: Params) -> np.ndarray:
    """Lower and upper bound of each grade on the scale of the weights' sums."""
    inner = p["first"][0] + np.concatenate(([0.0], np.cumsum(np.exp(p["gaps"]))))
    return np.concatenate(([-np.inf], inner, [np.inf]))


def below(t: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(t), (t > 0).astype(float), sigmoid(np.where(np.isinf(t), 0, t)))


def learn(vocab: np.ndarray, steps: int, l1: dict[str, float]):
    def run(params: Params, x: list[np.ndarray], y: np.ndarray, turn: int) -> Params:
        descent = Descent(params, RATE, l1, {"first": 1e-2, "gaps": 1e-2})
        at, starts = positions(vocab, x)
        size, n = np.diff(starts), len(y)
        for _ in range(steps):
            p = descent.params
            f, t = sums(p["w"][at], starts), thresholds(p)
            upper, lower = below(t[y + 1] - f), below(t[y] - f)
            chance = np.maximum(upper - lower, 1e-9)
            error = (1 - upper - lower) / n
            # slope of each inner threshold: it is the upper bound of its grade, the lower of the next
            pull = np.bincount(y + 1, -upper * (1 - upper) / chance / n, len(t))
            pull += np.bincount(y, lower * (1 - lower) / chance / n, len(t))
            pull = pull[1:-1]
            later = np.cumsum(pull[::-1])[::-1]
            descent.step({
                "first": later[:1], "gaps": later[1:] * np.exp(p["gaps"]),
                "w": np.bincount(at, np.repeat(error, size), len(vocab)),
            })
        return descent.params

    return run


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_col: str = "doc_id",
        text_col: str = "text", sample: int = hashed.SAMPLE) -> tuple[np.ndarray, Params]:
    """Vocabulary and parameters, learnt from at most ``sample`` labelled rows that are not held out."""
    rows = hashed.labelled(docs, labels, grade, id_col, text_col, shapes=True, sample=sample, name="graded_rows")
    vocab = hashed.vocabulary(rows, LEAST_ROWS, MOST_TERMS)
    params = {"first": np.array([-2.0]), "gaps": np.zeros(grades - 2), "w": np.zeros(len(vocab))}
    params = hashed.average(rows, params, learn(vocab, CHOOSE[1], L1), CHOOSE[0])
    live = np.abs(params["w"]) > LIVE
    vocab, params["w"] = vocab[live], params["w"][live]
    return vocab, hashed.average(rows, params, learn(vocab, FIT[1], {"w": L1["w"] / 10}), FIT[0])


def score(text: Column, vocab: np.ndarray, params: Params, tail: int = 1) -> Column:
    """Struct of a text's expected_grade, tail_prob (grade ``tail`` or better) and grade (the median)."""
    t = thresholds(params)

    @F.pandas_udf("expected_grade double, tail_prob double, grade int")
    def run(texts: pd.Series) -> pd.DataFrame:
        held = hashed.held_positions(vocab, texts, shapes=True)
        f = np.concatenate([sums(params["w"][at], starts) for at, starts in held])
        atleast = 1 - below(t[None, 1:-1] - f[:, None])
        return pd.DataFrame({
            "expected_grade": atleast.sum(axis=1), "tail_prob": atleast[:, tail - 1],
            "grade": (atleast >= 0.5).sum(axis=1).astype(np.int32),
        })

    return run(text)


def graded(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           sample: int = hashed.SAMPLE) -> DataFrame:
    """(id, held_out, expected_grade, tail_prob, grade, keep) for every row of ``docs``.

    ``tail_prob`` is the chance of grade 1 or better, ``grade`` the median grade and ``keep``
    whether it is 1 or better. Held-out ids (CRC of the id as text divisible by 5) are never
    learnt from; null qualities, unknown and repeated documents count as in ``hashed.labelled``.
    A text without known terms (null, empty) is judged by the thresholds alone, which keep it
    unless learning moved them. An empty table gives an empty result; only id and text are read.
    """
    vocab, params = fit(docs, labels, grade_of(F.col("quality"), F.col("toxic")), 3, id_col, text_col, sample)
    judged = docs.select(
        id_col, hashed.held_out(id_col).alias("held_out"), score(F.col(text_col), vocab, params).alias("judged")
    )
    return judged.select(id_col, "held_out", "judged.*", (F.col("judged.tail_prob") >= 0.5).alias("keep"))
