"""Concatenation and mixtures of data sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import sample


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(reasoning: DataFrame, chat: DataFrame) -> tuple[Column, Column]:
    """Rows of both sets, from one pass."""
    marked = reasoning.select(F.lit(1).alias("own")).unionByName(chat.select(F.lit(0).alias("own")))
    both = marked.agg(F.struct(
        F.coalesce(F.sum("own"), F.lit(0)).alias("reasoning"), F.count_if(F.col("own") == 0).alias("chat")
    ).alias("n")).scalar()
    return both["reasoning"], both["chat"]


def mixture(
    reasoning: DataFrame, chat: DataFrame, chat_share: float, key: Sequence[str],
    mode: str = "reference", sample_seed=2407, shuffle_seed=3407,
) -> DataFrame:
    """Mix two sets and add the shuffled position.

    ``reference`` keeps all reasoning rows and adds ``int(n_reasoning * (1 - share))``
    chat rows. ``share`` makes chat rows the stated share of the result, as large as both
    sets allow. Wanting more chat rows than there are takes them all.
    """
    n_reasoning, n_chat = _counts(reasoning, chat)
    if mode == "reference":
        taken = sample.exact(
            chat, (n_reasoning * F.lit(1.0 - chat_share)).cast("bigint"), sample_seed, key
        )
        kept = reasoning
    elif mode == "share":
        per_reasoning = chat_share / (1.0 - chat_share)
        fit_chat = F.least(n_chat, F.floor(n_reasoning * F.lit(per_reasoning)))
        fit_reasoning = F.least(n_reasoning, F.floor(n_chat / F.lit(per_reasoning)))
        taken = sample.exact(chat, fit_chat, sample_seed, key)
        kept = sample.exact(reasoning, fit_reasoning, sample_seed, key)
    else:
        raise ValueError(f"unknown mixture mode: {mode}")
    return sample.shuffle(concatenate([kept, taken]), shuffle_seed, key)
