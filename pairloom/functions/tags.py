"""Answers inside marked-up responses and sources inside prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.functions.text import FLAT_SPACE as SPACE
from pairloom.functions.text import strip

# (?d) lets only \n end a line, as in the patterns' original dialect.
_FLAGS = "(?smd)"
_RE2_FLAGS = "(?sm)"
_STRICT = (
    f"^[{SPACE}]*{fixed.WORK_START}.+?{fixed.WORK_END}.*?"
    f"{fixed.SOLUTION_START}(.+?){fixed.SOLUTION_END}[{SPACE}]*$"
)
_LOOSE = (
    f"{fixed.WORK_END}.*?{fixed.SOLUTION_START}(.+?){fixed.SOLUTION_END}"
    f"[{SPACE}]*(?:%s)?[{SPACE}]*$"
)
_NUMBER = f"{fixed.SOLUTION_START}.*?([\\p{{Nd}}.]+)"
_SIGNED_NUMBER = f"{fixed.SOLUTION_START}.*?[{SPACE}]*(-?[\\p{{Nd}}.,]+)"


def pattern(kind: str, eos: str = fixed.EOS, re2: bool = False) -> str:
    """Regex for ``strict``, ``loose``, ``number`` or ``signed_number``."""
    body = {
        "strict": _STRICT,
        "loose": _LOOSE % re.escape(eos),
        "number": _NUMBER,
        "signed_number": _SIGNED_NUMBER,
    }[kind]
    return (_RE2_FLAGS if re2 else _FLAGS) + body


def first_group(s: Column, regex: str) -> Column:
    """First group of the first match, NULL without a match."""
    return F.when(s.rlike(regex), F.regexp_extract(s, regex, 1))


def solution_strict(s: Column) -> Column:
    return first_group(s, pattern("strict"))


def solution_loose(s: Column, eos: str = fixed.EOS) -> Column:
    return first_group(s, pattern("loose", eos))


def solution_number(s: Column, signed: bool = False) -> Column:
    return first_group(s, pattern("signed_number" if signed else "number"))


def hash_answer(s: Column) -> Column:
    """Text between the first and second ``####``; NULL where there is none."""
    return F.when(
        F.contains(s, F.lit(fixed.ANSWER_MARK)),
        strip(F.split_part(s, F.lit(fixed.ANSWER_MARK), F.lit(2))),
    )


SOURCE_PATTERN = fixed.INSTRUCTION + r"([^\n]+)"


def has_instruction(prompt: Column) -> Column:
    return prompt.rlike(SOURCE_PATTERN)


def source_after_instruction(prompt: Column) -> Column:
    """Rest of the line after the instruction; NULL without the instruction."""
    found = F.regexp_extract(prompt, SOURCE_PATTERN, 1)  # the group is never empty in a match
    return strip(F.nullif(found, F.lit("")))


def source_after_colon(prompt: Column) -> Column:
    """Text after the last full-width colon, else after the last ASCII colon."""
    return strip(
        F.when(F.contains(prompt, F.lit("：")), F.substring_index(prompt, "：", -1))
        .otherwise(F.substring_index(prompt, ":", -1))
    )


def strip_prompt(generated: Column, prompt: Column) -> Column:
    """What follows the last occurrence of the prompt in a generated text."""
    return strip(F.split_part(generated, prompt, F.lit(-1)))


def reasoning_answer(trace: Column, answer: Column) -> Column:
    """Trace without think tags, wrapped in working-out tags, followed by the answer."""
    for tag in fixed.THINK_TAGS:
        trace = F.replace(trace, F.lit(tag), F.lit(""))
    return F.concat(
        F.lit(fixed.WORK_START), strip(trace), F.lit(fixed.WORK_END),
        F.lit(fixed.SOLUTION_START), answer, F.lit(fixed.SOLUTION_END),
    )
