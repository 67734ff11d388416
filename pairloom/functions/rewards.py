"""Rule-based rewards as Column builders.

A rule takes the ``Measures`` of a row and returns a double. ``REWARDS`` is the registry;
``register`` adds a builder over the plain ``(prompt, response, answer)`` columns, and
``python_reward`` adapts Python functions that take aligned lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import fixed, tags
from pairloom.functions import text as T
from pairloom.functions.measures import Measures

Rule = Callable[[Measures], Column]
Reward = Callable[[Column, Column, Column], Column]
REWARDS: dict[str, Rule] = {}


def register(name: str, reward: Reward) -> None:
    """Add a reward over prompt, response and answer text."""
    REWARDS[name] = lambda m: reward(m["prompt"], m["response"], m["answer"])


def _steps(*steps: tuple[Column, float], default: float) -> Column:
    """First step whose condition holds decides the points."""
    points = None
    for condition, value in steps:
        value = F.lit(float(value))
        points = F.when(condition, value) if points is None else points.when(condition, value)
    return points.otherwise(F.lit(float(default)))


def composite(m: Measures) -> Column:
    """Eight-part reward on a response to the fixed instruction, floored at -10."""
    share, size, kept, total = m["share"], m["size"], m["marks_kept"], m["japanese_total"]
    points = (
        _steps((share >= 0.95, 4), (share >= 0.85, 2), (share >= 0.70, 0.5), default=-3)
        + (m["hira"] * F.lit(-0.8) + m["kanji"] * F.lit(-1.2))
        + _steps(
            (size.between(0.8, 2.5), 2.5), (size.between(0.6, 3.0), 1),
            (size > 4.0, -4), (size < 0.5, -3), default=0,
        )
        + _steps(
            (m["source_marks"] == 0, 0), (kept.between(0.8, 1.2), 1.5), (kept < 0.5, -1),
            default=0,
        )
        + _steps((total >= m["source_total"] * F.lit(0.8), 1.5), default=-2)
        + _steps((m["explained"], -2), default=1)
        + _steps((total == 0, 0), (share >= 0.9, 1), (share < 0.7, -1.5), default=0)
        + _steps((m["letters"] + m["digits"] > 0, 0.5), default=0)
    )
    invalid = m["source"].isNull() | (m["resp_length"] == 0)
    return F.when(invalid, F.lit(-5.0)).otherwise(F.greatest(points, F.lit(-10.0)))


def purity(m: Measures) -> Column:
    share = m["purity"]
    return _steps(
        (m["resp_length"] == 0, -3), (share.isNull(), -2), (share == 1, 4), (share >= 0.98, 3.5),
        (share >= 0.95, 3), (share >= 0.9, 2), (share >= 0.8, 1), (share >= 0.6, 0.2),
        default=-2.5,
    )


def length(m: Measures) -> Column:
    share = m["packed_share"]
    return _steps(
        (m["colon_packed"] == 0, 0), (share.between(0.9, 1.3), 3), (share.between(0.8, 1.6), 2),
        (share.between(0.6, 2.0), 0.8), (share.between(0.4, 3.0), 0.2),
        (share > 4.0, -3), (share < 0.3, -2.5), default=-1.5,
    )


def unwanted(m: Measures) -> Column:
    penalty = (
        m["letters"] * F.lit(0.5) + m["ascii_digits"] * F.lit(0.4) + m["hira"] * F.lit(0.8)
        + m["kanji"] * F.lit(1.2) + m["symbols"] * F.lit(0.3)
    )
    return F.lit(0.0) - penalty - _steps((m["resp_length"] == 0, 3), default=0)


def completeness(m: Measures) -> Column:
    n, newlines = m["resp_length"], m["newlines"]
    size = _steps(
        (n == 0, -4), (n <= 2, -2), (n <= 5, -0.5), (n <= 80, 2), (n <= 120, 1), (n <= 200, -0.8),
        default=-2.5,
    )
    return (
        size
        - F.when(newlines > 1, newlines * F.lit(0.5)).otherwise(F.lit(0.0))
        - _steps((m["double_space"], 0.3), default=0)
    )


def output_format(m: Measures) -> Column:
    """Unwanted phrases cost, purity and brevity pay; nested phrases count each."""
    share = m["purity"]
    brief = m["resp_length"].between(3, 30) & (m["ascii_spaces"] <= 2)
    return (
        m["phrase_hits"] * F.lit(-0.4)
        + _steps((share == 1, 2.5), (share >= 0.95, 1.8), (share >= 0.9, 1.2), default=0)
        + _steps((brief, 0.8), default=0)
    )


def repetition(m: Measures) -> Column:
    """Points off for characters beyond the source's length and for monotonous texts."""
    n, source = m["resp_length"], m["colon_length"]
    monotonous = (n > 5) & m["monotonous"]
    points = (
        m["chars_above_source"] * F.lit(-0.5)
        - _steps((monotonous, 1.5), default=0)
        - _steps(((m["packed_length"] < 3) & (source > 8), 1), default=0)
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(points)


def tag_match(kind: str, points: float = 3.0) -> Rule:
    return lambda m: _steps((m["response"].rlike(tags.pattern(kind)), points), default=0)


def tag_counts(names: Sequence[str], once: float, otherwise: float) -> Rule:
    def rule(m):
        scores = [
            _steps((T.count_phrase(m["response"], t) == 1, once), default=otherwise)
            for t in names
        ]
        return sum(scores, F.lit(0.0))

    return rule


def answer_check(
    kind: str, missing: float, equal: float, stripped: float, close: float, near: float,
    wrong: float, error: float,
) -> Rule:
    """Compare the tagged solution with the answer as text, then as a ratio of numbers.

    A NULL answer gives NULL: there is nothing to compare the guess with.
    """

    def rule(m):
        guess, answer, share = m[f"{kind}_guess"], m["answer"], m[f"{kind}_share"]
        compared = _steps(
            (guess == answer, equal), (T.strip(guess) == T.strip(answer), stripped),
            (share.isNull(), error), (share.between(0.9, 1.1), close),
            (share.between(0.8, 1.2), near), default=wrong,
        )
        return F.when(guess.isNull(), F.lit(float(missing))).when(answer.isNotNull(), compared)

    return rule


def number_check(
    found: str, missing: float, equal: float, wrong: float, error: float = 0.0
) -> Rule:
    """Compare the first number after the solution tag with the answer."""

    def rule(m):
        guess, truth = m[f"{found}_value"], m["truth"]
        return _steps(
            (m[found].isNull(), missing), (guess.isNull() | truth.isNull(), error),
            ((guess == truth) & ~F.isnan(truth), equal), default=wrong,
        )

    return rule


ALL_TAGS = (fixed.WORK_START, fixed.WORK_END, fixed.SOLUTION_START, fixed.SOLUTION_END)

REWARDS.update({
    "composite": composite,
    "purity": purity,
    "length": length,
    "unwanted": unwanted,
    "completeness": completeness,
    "format": output_format,
    "repetition": repetition,
    "format_exact_strict": tag_match("strict"),
    "tags_strict": tag_counts(ALL_TAGS, 0.5, -0.5),
    "answer_strict": answer_check("strict", 0, 3, 1.5, 0.5, 0.25, -1, -0.5),
    "number_strict": number_check("number", 0, 1.5, 0),
    "format_exact_loose": tag_match("loose"),
    # The opening tag is always supplied by the prompt, so it is not scored here.
    "tags_loose": tag_counts(ALL_TAGS[1:], 0.5, -1),
    "answer_loose": answer_check("loose", -2, 5, 3.5, 2, 1.5, -2.5, -4.5),
    "number_loose": number_check("signed_number", -2.5, 3.5, -1.5),
})

CONVERSION_REWARDS = ("purity", "length", "unwanted", "completeness", "format", "repetition")
STRICT_REWARDS = ("format_exact_strict", "tags_strict", "answer_strict", "number_strict")
LOOSE_REWARDS = ("format_exact_loose", "tags_loose", "answer_loose", "number_loose")


def _messages(value, role: str):
    """A message list; a plain text is one message of the role."""
    if value is None or isinstance(value, str):
        return [{"role": role, "content": value}]
    return [{"role": m["role"], "content": m["content"]} for m in value]


def python_reward(fn: Callable[..., list[float]]) -> Callable[..., Column]:
    """Adapt ``fn(prompts=…, completions=…, **columns) -> list[float]`` to a Column builder.

    The builder takes Columns by the same keywords (or, in this order, prompts, completions
    and answer); ``fn`` gets a list for each. Prompts and
    completions are lists of message lists, whole as they are, or plain texts as one message.
    Rows cross to Python in Arrow batches; write the rule as a Column builder where that is
    possible.
    """

    @F.pandas_udf("double")
    def scored(rows: pd.DataFrame) -> pd.Series:
        lists = {c: rows[c].tolist() for c in rows.columns}
        for name, role in (("prompts", "user"), ("completions", "assistant")):
            if name in lists:
                lists[name] = [_messages(v, role) for v in lists[name]]
        return pd.Series(fn(**lists), dtype="float64")

    def build(*given: Column, **columns: Column) -> Column:
        columns = dict(zip(("prompts", "completions", "answer"), given, strict=False)) | columns
        return scored(F.struct(*(c.alias(name) for name, c in columns.items())))

    return build


def python_pair_reward(fn: Callable[[str, str], float]) -> Callable[..., Column]:
    """Adapt ``fn(prompt, response) -> float`` over the last prompt and first response content."""

    def each(prompts, completions, **_):
        return [
            fn(p[-1]["content"] if p else "", c[0]["content"] if c else "")
            for p, c in zip(prompts, completions, strict=True)
        ]

    return python_reward(each)
