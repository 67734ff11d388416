"""Rewards against plain Python statements of the same rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import fixed, rewards
from pairloom.operators import score
from tests.samples import texts
from tests.test_text import HIRA, KANJI, KATA, is_english, japanese, n_if, n_in

INF = math.inf


def first(steps, default):
    return next((points for holds, points in steps if holds), default)


def within(x, low, high):
    return low <= x <= high


def colon_source(prompt):
    return prompt.split("：" if "：" in prompt else ":")[-1].strip()


def nonspace_purity(r):
    solid = [c for c in r if not c.isspace()]
    return n_in(r, KATA) / len(solid) if solid else None


def composite(prompt, response, _):
    found = re.search(fixed.INSTRUCTION + "(.+)", prompt)
    r = response.strip()
    if not found or not r:
        return -5.0
    source = found[1].strip()
    total, share = japanese(r), n_in(r, KATA) / max(japanese(r), 1)
    size = len(r) / max(len(source), 1)
    marks = [n_if(t, lambda c: c in fixed.PUNCTUATION) for t in (source, r)]
    kept = marks[1] / marks[0] if marks[0] else None
    points = [
        first([(share >= .95, 4), (share >= .85, 2), (share >= .7, .5)], -3),
        -.8 * n_in(r, HIRA) - 1.2 * n_in(r, KANJI),
        first([(within(size, .8, 2.5), 2.5), (within(size, .6, 3), 1), (size > 4, -4), (size < .5, -3)], 0),
        0 if kept is None else first([(within(kept, .8, 1.2), 1.5), (kept < .5, -1)], 0),
        1.5 if total >= japanese(source) * .8 else -2,
        -2 if any(p in r for p in fixed.EXPLANATIONS) else 1,
        first([(total == 0, 0), (share >= .9, 1), (share < .7, -1.5)], 0),
        .5 if any(is_english(c) or c.isdigit() for c in r) else 0,
    ]
    return max(sum(points), -10)


def purity(prompt, response, _):
    p = nonspace_purity(response.strip())
    if p is None:
        return -3
    return first([(p == 1, 4), (p >= .98, 3.5), (p >= .95, 3), (p >= .9, 2), (p >= .8, 1), (p >= .6, .2)], -2.5)


def length(prompt, response, _):
    n = len(colon_source(prompt).replace(" ", ""))
    if n == 0:
        return 0
    x = len(response.strip().replace(" ", "")) / n
    ranges = [(.9, 1.3, 3), (.8, 1.6, 2), (.6, 2, .8), (.4, 3, .2), (math.nextafter(4, 5), INF, -3),
              (0, math.nextafter(.3, 0), -2.5)]
    return first([(within(x, a, b), p) for a, b, p in ranges], -1.5)


def unwanted(prompt, response, _):
    r = response.strip()
    cost = .5 * n_if(r, is_english) + .4 * n_if(r, lambda c: c in "0123456789")
    cost += .8 * n_in(r, HIRA) + 1.2 * n_in(r, KANJI)
    cost += .3 * n_if(r, lambda c: c in fixed.UNWANTED_SYMBOLS)
    return -cost - (0 if r else 3)


def completeness(prompt, response, _):
    r = response.strip()
    bounds = [(0, -4), (2, -2), (5, -.5), (80, 2), (120, 1), (200, -.8), (INF, -2.5)]
    lines = r.count("\n")
    return (first([(len(r) <= b, p) for b, p in bounds], None)
            - (lines * .5 if lines > 1 else 0) - (.3 if "  " in r else 0))


def output_format(prompt, response, _):
    r = response.strip()
    p = nonspace_purity(r)
    bonus = 0 if p is None else first([(p == 1, 2.5), (p >= .95, 1.8), (p >= .9, 1.2)], 0)
    brief = .8 if within(len(r), 3, 30) and r.count(" ") <= 2 else 0
    return -.4 * sum(map(r.count, fixed.UNWANTED_PHRASES)) + bonus + brief


def repetition(prompt, response, _):
    r, n = response.strip(), len(colon_source(prompt))
    dense = r.replace(" ", "")
    if not r:
        return 0
    return (-.5 * sum(r.count(c) > n for c in set(r))
            - 1.5 * (len(set(dense)) < 3 and len(r) > 5) - (len(dense) < 3 and n > 8))


JAPANESE = {
    "composite": composite, "purity": purity, "length": length, "unwanted": unwanted,
    "completeness": completeness, "format": output_format, "repetition": repetition,
}


def prompts(response, i):
    source = (response[: i % 40] or "天気") + ["", " ", "天気です。", "A:B", "長い文章" * 5][i % 5]
    return [fixed.INSTRUCTION + source, "x: " + source, fixed.INSTRUCTION + source + "\nx"][i % 3]


@pytest.fixture(scope="module")
def japanese_rows(spark):
    data = [(prompts(r, i), r) for i, r in enumerate(texts(900, 11))]
    # Rows on both sides of thresholds: purity 49/50 and 19/20, ratios 0.9, 1.3, 4.0.
    for n, other in ((49, 1), (19, 1), (9, 1), (4, 1), (3, 2)):
        data.append((fixed.INSTRUCTION + "天" * (n + other), "ア" * n + "あ" * other))
    for n in (2, 3, 4, 6, 8, 9, 10, 13, 14, 16, 17, 20, 21, 25, 30, 31, 40, 41):
        data.append((fixed.INSTRUCTION + "天" * 10, "アイウエオカキクケコ"[: n] + "サ" * max(n - 10, 0)))
    frame = spark.createDataFrame(data, "prompt string, response string")
    return score.score(frame, list(JAPANESE), "prompt").collect()


@pytest.mark.parametrize("name", JAPANESE)
def test_conversion_reward(japanese_rows, name):
    for row in japanese_rows:
        expected = JAPANESE[name](row["prompt"], row["response"], None)
        assert row[f"reward_{name}"] == pytest.approx(expected, abs=1e-6), row


S, E, A, B = rewards.ALL_TAGS
STRICT = re.compile(rf"^\s*{S}.+?{E}.*?{A}(.+?){B}\s*$", re.M | re.S)
LOOSE = re.compile(rf"{E}.*?{A}(.+?){B}\s*(?:{re.escape(fixed.EOS)})?\s*$", re.M | re.S)
NUMBER = re.compile(rf"{A}.*?([\d.]+)", re.S)
SIGNED = re.compile(rf"{A}.*?\s*(-?[\d.,]+)", re.S)


def answer_rule(regex, missing, equal, stripped, close, near, wrong, error):
    def rule(prompt, response, answer):
        found = regex.search(response)
        if not found:
            return missing
        if answer is None:
            return None
        if found[1] == answer:
            return equal
        if found[1].strip() == answer.strip():
            return stripped
        try:
            x = float(found[1]) / float(answer)
        except (ValueError, ZeroDivisionError):
            return error
        return first([(within(x, .9, 1.1), close), (within(x, .8, 1.2), near)], wrong)

    return rule


def number_rule(regex, missing, equal, wrong):
    def rule(prompt, response, answer):
        found = regex.search(response)
        if not found:
            return missing
        try:
            guess = float(found[1].replace(",", "") if regex is SIGNED else found[1])
            return equal if guess == float(answer.strip()) else wrong
        except (ValueError, AttributeError):
            return 0

    return rule


def tag_rule(tags, otherwise):
    return lambda p, r, a: sum(.5 if r.count(t) == 1 else otherwise for t in tags)


NUMERIC = {
    "format_exact_strict": lambda p, r, a: 3 if STRICT.search(r) else 0,
    "tags_strict": tag_rule([S, E, A, B], -.5),
    "answer_strict": answer_rule(STRICT, 0, 3, 1.5, .5, .25, -1, -.5),
    "number_strict": number_rule(NUMBER, 0, 1.5, 0),
    "format_exact_loose": lambda p, r, a: 3 if LOOSE.search(r) else 0,
    "tags_loose": tag_rule([E, A, B], -1),
    "answer_loose": answer_rule(LOOSE, -2, 5, 3.5, 2, 1.5, -2.5, -4.5),
    "number_loose": number_rule(SIGNED, -2.5, 3.5, -1.5),
}
GUESSES = ["10", " 10 ", "\n10\n", "9", "11", "8", "12", "7.9", "12.1", "-10", "1,0", "1.0.0", "ten",
           "nan", "inf", "1e1", "", "$10", "10d", "20", "１０", "１１．０", "1_0", "1__0", "٩"]
SHAPES = [f"{S}think{E}{A}%s{B}", f"think{E}{A}%s{B}", f"{S}a\nb{E}\nso\n{A}%s{B}  \n\n",
          f"{S}a{E}{A}%s{B}{fixed.EOS}\n", f"{A}%s{B}", "%s", f"x\n{S}a{E}{A}%s{B}\ny",
          f"{S}a{E}{A}%s", f"{S}{E}{A}%s{B}", f"{S}a{E}{A}1{B} {S}a{E}{A}%s{B}"]


@pytest.fixture(scope="module")
def numeric_rows(spark):
    data = [
        ("p", shape % guess, answer) for shape in SHAPES for guess in GUESSES
        for answer in ("10", " 10", "0", "ten", "nan", None)
    ]
    frame = spark.createDataFrame(data, "prompt string, response string, answer string")
    return score.score(frame, list(NUMERIC), "prompt", answer="answer").collect()


@pytest.mark.parametrize("name", NUMERIC)
def test_numeric_reward(numeric_rows, name):
    for row in numeric_rows:
        expected = NUMERIC[name](row["prompt"], row["response"], row["answer"])
        assert row[f"reward_{name}"] == expected, row


def test_messages_totals_and_registered_rewards(spark):
    rows = [([("user", "x"), ("user", "a：天")], [("assistant", "アイ")])]
    message = "array<struct<role string, content string>>"
    frame = spark.createDataFrame(rows, f"prompt {message}, completion {message}")
    rewards.register("shortness", lambda p, r, a: F.length(p) - F.length(r) * 1.0)
    rewards.register("python", rewards.python_pair_reward(lambda p, r: len(p) + 10 * len(r)))
    try:
        row = score.score(
            frame, ["shortness", "python", "length"], "prompt", "completion", total="total"
        ).first()
    finally:
        del rewards.REWARDS["shortness"], rewards.REWARDS["python"]
    assert (row.reward_shortness, row.reward_python, row.reward_length) == (1.0, 23.0, 0.8)
    assert row.total == 24.8


def test_group_stats_and_hot_prompt(spark):
    frame = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("prompt_id"),
        (F.col("id") % 7 * 1.0).alias("r"), F.repeat(F.lit("ア"), (F.col("id") % 5).cast("int")).alias("c"),
    )
    groups = {}
    for row in frame.collect():
        groups.setdefault(row[0], []).append((row[1], len(row[2])))
    for row in score.group_stats(frame, ["prompt_id"], "r", "c").collect():
        got = groups[row[0]]
        mean = sum(r for r, _ in got) / len(got)
        std = math.sqrt(sum((r - mean) ** 2 for r, _ in got) / (len(got) - 1))
        assert row.n_generations == len(got)
        assert row.reward == pytest.approx(mean, abs=1e-6)
        assert row.reward_std == pytest.approx(std, abs=1e-6)


def test_generated_methods_stay_compilable(spark, capsys):
    """HotSpot leaves methods above 8,000 bytes to the interpreter."""
    frame = spark.createDataFrame([("p", "r", "a")], "prompt string, response string, answer string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for names in (["composite"], rewards.CONVERSION_REWARDS, rewards.LOOSE_REWARDS):
            scored = score.score(frame.repartition(1), list(names), "prompt", answer="answer", total="t")
            scored.explain("codegen")
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
            assert sizes and max(map(int, sizes)) < 8000, (names, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
