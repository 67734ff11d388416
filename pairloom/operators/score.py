"""Rollout tables: joins on keys, reward columns, group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from pairloom.functions.measures import Measures
from pairloom.functions.rewards import REWARDS


def join_rollouts(
    prompts: DataFrame, completions: DataFrame, answers: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Prompts, completions and answers aligned by key.

    Every completion stays: without a prompt or an answer these are NULL, and rewards that
    need them are too. Prompts and answers hold one row per key, so a hot key only makes the
    completion side large, which the adaptive skew join splits.
    """
    return completions.join(prompts, list(key), "left").join(answers, list(key), "left")


def _text(df: DataFrame, column: str | None, position: int) -> Column:
    """A text column as it is; of a message array the content at ``position``, empty if it has none."""
    if column is None:
        return F.lit(None).cast("string")
    if isinstance(df.schema[column].dataType, ty.ArrayType):
        content = F.try_element_at(F.col(column), F.lit(position))["content"]
        return F.when(F.col(column).isNotNull(), F.coalesce(content, F.lit("")))
    return F.col(column)


def score(
    df: DataFrame, names: Sequence[str], prompt: str | None = None,
    response: str = "response", answer: str | None = None, total: str | None = None,
) -> DataFrame:
    """Add ``reward_<name>`` columns and, if asked for, their sum."""
    measures = Measures(
        _text(df, prompt, -1), _text(df, response, 1), _text(df, answer, 1)
    )
    rewards = {f"reward_{n}": F.round(REWARDS[n](measures), 6) for n in names}
    scored = measures.drop_from(measures.add_to(df).withColumns(rewards))
    if total is None:
        return scored
    # A NULL reward marks an invalid row and makes the total NULL.
    summed = sum((F.col(f"reward_{n}") for n in names), F.lit(0.0))
    return scored.withColumn(total, F.round(summed, 6))


def group_stats(
    df: DataFrame, key: Sequence[str], reward: str, completion: str
) -> DataFrame:
    """Mean and sample deviation of the reward and mean completion length per prompt."""
    return df.groupBy(*key).agg(
        F.count("*").alias("n_generations"),
        F.round(F.avg(reward), 6).alias("reward"),
        F.round(F.stddev_samp(reward), 6).alias("reward_std"),
        F.round(F.avg(F.length(completion)), 6).alias("completion_length"),
    )


def step_log(df: DataFrame, step: str, key: Sequence[str], reward: str, completion: str) -> DataFrame:
    """Means of the prompts' group statistics for each step, and in the row without step over all steps.

    A step's prompts count alike, however many completions each has; the deviation of a single
    completion is none and doesn't count. Groups are made once, with partial aggregates.
    """
    groups = df.groupBy(step, *(k for k in key if k != step)).agg(
        F.count("*").alias("n"), F.avg(reward).alias("reward"), F.stddev_samp(reward).alias("reward_std"),
        F.avg(F.length(completion)).alias("completion_length"),
    )
    means = [F.round(F.avg(c), 6).alias(c) for c in ("reward", "reward_std", "completion_length")]
    return groups.groupingSets([[step], []], step).agg(
        F.count("*").alias("n_prompts"), F.sum("n").alias("n_generations"), *means
    )
