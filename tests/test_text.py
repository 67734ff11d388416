import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from tests.samples import texts

KATA, HIRA, KANJI = ("゠", "ヿ"), ("぀", "ゟ"), ("一", "龯")


def n_in(s, block):
    return sum(block[0] <= c <= block[1] for c in s)


def n_if(s, test):
    return sum(map(test, s))


def is_english(c):
    return c.isascii() and c.isalpha()


def japanese(s):
    blocks = n_in(s, KATA) + n_in(s, HIRA) + n_in(s, KANJI)
    return blocks + n_if(s, is_english) + n_if(s, str.isdigit)


def counted_inline(c):
    return any(b[0] <= c <= b[1] for b in (KATA, HIRA, KANJI)) or c.isalnum()


EXPECTED = {
    "strip": (T.strip, str.strip),
    "blank": (T.is_blank, lambda s: not s.strip()),
    "katakana": (lambda c: T.count_class(c, T.KATAKANA), lambda s: n_in(s, KATA)),
    "hiragana": (lambda c: T.count_class(c, T.HIRAGANA), lambda s: n_in(s, HIRA)),
    "kanji": (lambda c: T.count_class(c, T.KANJI), lambda s: n_in(s, KANJI)),
    "english": (lambda c: T.count_class(c, T.ASCII_LETTER), lambda s: n_if(s, is_english)),
    "digits": (lambda c: T.count_class(c, T.DIGIT), lambda s: n_if(s, str.isdigit)),
    "alnum": (lambda c: T.count_class(c, T.ALNUM), lambda s: n_if(s, str.isalnum)),
    "nonspace": (T.nonspace_length, lambda s: n_if(s, lambda c: not c.isspace())),
    "marks": (lambda c: T.count_class(c, T.PUNCTUATION), lambda s: n_if(s, lambda c: c in "。、！？・「」（）")),
    "total": (T.japanese_total, japanese),
    "profile": (T.profile_ratio, lambda s: n_in(s, KATA) / max(japanese(s), 1)),
    "fast": (
        lambda c: T.script_profile(c, "fast")["katakana_ratio"],
        lambda s: n_in(s, KATA)
        / max(n_in(s, KATA) + n_in(s, HIRA) + n_in(s, KANJI) + n_if(s, str.isalnum), 1),
    ),
    "inline": (T.inline_ratio, lambda s: n_in(s, KATA) / max(n_if(s, counted_inline), 1)),
    "purity": (
        T.purity_nonspace,
        lambda s: n_in(s, KATA) / n_if(s, lambda c: not c.isspace()) if s.split() else None,
    ),
    "purity_length": (T.purity_length, lambda s: n_in(s, KATA) / max(len(s.replace(" ", "")), 1)),
    "desu": (lambda c: T.count_phrase(c, "です"), lambda s: s.count("です")),
    "pairs": (lambda c: T.count_phrase(c, "アア"), lambda s: s.count("アア")),
    "phrases": (lambda c: T.count_phrases(c, ["は", "です", "アア"]), lambda s: s.count("は") + s.count("です") + s.count("アア")),
    "distinct": (T.n_distinct_chars, lambda s: len(set(s))),
    "few": (lambda c: T.fewer_distinct(c, 3), lambda s: len(set(s.replace(" ", ""))) < 3),
    "words": (lambda c: T.token_len(c, "words"), lambda s: len(s.split())),
    "preview": (lambda c: T.preview(c, 10), lambda s: s[:10] + "..." if len(s) > 10 else s),
}


@pytest.fixture(scope="module")
def rows(spark):
    data = spark.createDataFrame([(s,) for s in texts(400, 1)], "s string")
    columns = [build(F.col("s")).alias(name) for name, (build, _) in EXPECTED.items()]
    return data.select("s", *columns).collect()


@pytest.mark.parametrize("name", EXPECTED)
def test_against_python(rows, name):
    for row in rows:
        assert row[name] == EXPECTED[name][1](row["s"]), row["s"]


def test_counts_struct(spark):
    data = spark.createDataFrame([(s,) for s in texts(200, 2)], "s string")
    for s, c in data.select("s", T.script_counts(F.col("s"))).collect():
        assert tuple(c) == (
            n_in(s, KATA), n_in(s, HIRA), n_in(s, KANJI), n_if(s, is_english), n_if(s, str.isdigit)
        )


def test_chars_above(spark):
    data = [(s, n) for s in texts(300, 3) for n in (0, 1, 2, 5, 9)]
    frame = spark.createDataFrame(data, "s string, n int")
    for s, n, found in frame.select("s", "n", T.n_chars_above(F.col("s"), F.col("n"))).collect():
        assert found == sum(s.count(c) > n for c in set(s)), (s, n)


def test_digits_of_the_basic_plane(spark):
    """Characters that Java's older Unicode tables know."""
    points = [
        chr(p) for p in range(0x2FFF)
        if unicodedata.category(chr(p)) in ("Nd", "No", "Nl", "Lo") and chr(p).isdigit()
    ]
    frame = spark.createDataFrame([("".join(points),)], "s string")
    assert frame.select(T.count_class(F.col("s"), T.DIGIT)).first()[0] == len(points)


NUMBERS = {
    "12": 12.0, " 3.5 ": 3.5, "-.5": -0.5, "1e3": 1000.0, "5.": 5.0, "+7": 7.0, "inf": math.inf,
    "-Infinity": -math.inf, "1d": None, "1f": None, "1,000": None, "": None,
    "x": None, ".": None, "0x10": None, "\n4\n": 4.0, None: None,
}


@pytest.mark.parametrize("s", [
    "1_000", "１２", "-１２．５", "１２.５", "٣٤", "1__0", "_1", "1_", "1_0.5_0e1_0", "1._0", "1_.0", ".5_5", "𝟙𝟚", "²", "Ⅷ", "１_０",
    "+.5", "1e5", "1e_5", "０x1", "1 2", "inf_", "１e１", "　７　",
])
def test_numbers_as_python_reads_them(spark, s):
    try:
        wanted = float(s)
    except ValueError:
        wanted = None
    assert spark.range(1).select(T.parse_float(F.lit(s))).first()[0] == wanted
    assert not spark.range(1).select(T.is_number(F.lit("１２"))).first()[0]


def test_numbers(spark):
    frame = spark.createDataFrame([(k,) for k in [*NUMBERS, "nan", "-NaN"]], "s string")
    found = frame.select("s", T.parse_float(F.col("s")).alias("x"), T.is_number(F.col("s")).alias("ok"))
    for s, x, ok in found.collect():
        if s in ("nan", "-NaN"):
            assert math.isnan(x) and not ok
        else:
            assert x == NUMBERS[s] and ok == (x is not None), s


GOLDEN = [
    ("今日は良い天気です。", "キョウハヨイテンキデス。"),
    ("私は学生です。", "ワタシハガクセイデス。"),
    ("東京駅に行きます。", "トウキョウエキニユキマス。"),
]


def test_documented_rates(spark):
    frame = spark.createDataFrame(GOLDEN, "source string, target string")
    target = F.col("target")
    row = frame.select(
        T.inline_ratio(target), F.round(T.purity_nonspace(target), 3),
        T.script_profile(target, "fast")["katakana_ratio"],
        T.length_ratio(target, F.col("source")),
    ).first()
    assert tuple(row) == (1.0, 0.917, 0.5, 1.2)
    assert frame.where(T.inline_ratio(target) < 1).count() == 0
