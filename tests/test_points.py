"""Counts over code points against plain Python, and what plans do with them."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import fixed, points
from pairloom.functions import text as T
from pairloom.operators import score

ALPHABET = "aZ09 \n　アン・ー゠はですのカタナで変換結果答え²٣①💡é。！(é"
LIMIT = 3


def plain(text):
    if text is None:
        return [None] * (len(T.KINDS) + 3)
    kinds = [sum(ord(c) in members for c in text) for members in map(set, T.KINDS.values())]
    return [*kinds, sum(text.count(p) for p in [*fixed.UNWANTED_PHRASES, "アア"]),
            min(3, len(set(text) - {" "})), sum(text.count(c) > LIMIT for c in set(text))]


def test_kinds_share_no_character():
    assert sum(map(len, T.KINDS.values())) == len(set().union(*T.KINDS.values()))


@pytest.mark.parametrize("piece", [1, 64, points.PIECE])
def test_scan_against_python(spark, piece):
    rng = random.Random(piece)
    texts = [None, "", " ", "ア" * 50 + "B", "アア", "ア", *("".join(rng.choices(ALPHABET, k=rng.randrange(90))) for _ in range(300))]
    texts.insert(100, " " * 40 + "a" * 40 + "bc")
    df = spark.createDataFrame(pd.DataFrame({"s": texts}), "s string").coalesce(1)

    def counted(s):
        return points.scan(s, T.KINDS, {"phrases": [*fixed.UNWANTED_PHRASES, "アア"]}, {"few": 3}, {"above": F.lit(LIMIT)}, piece=piece)

    got = [list(r.c) for r in df.select(counted(F.col("s")).alias("c")).collect()]
    assert [[None] * len(g) if t is None else g for t, g in zip(texts, got, strict=True)] == [plain(t) for t in texts]


def test_null_limits_and_broken_bytes(spark):
    df = spark.createDataFrame([("aab", None), ("aab", 1), ("", 0)], "s string, n int").coalesce(1)
    assert [r[0] for r in df.select(T.n_chars_above(F.col("s"), F.col("n"))).collect()] == [None, 1, 0]
    broken = df.limit(1).select(F.expr("cast(X'61FF62616E' as string)").alias("s"))
    assert broken.select(points.scan(F.col("s"), {"a": [97]})["a"]).first()[0] == 2


def test_conversion_rewards_read_a_response_once(spark):
    """All counts of a response are one pass, whatever number of rewards needs them."""
    df = spark.createDataFrame([("x：漢字", "カンジです")], "prompt string, response string")
    names = ["purity", "length", "unwanted", "completeness", "format", "repetition"]
    plan = score.score(df, names, "prompt", total="all")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "regexp" not in plan
