"""Positions, prefixes, samples and mixtures against brute force, on skewed keys."""

import hashlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.functions import text as T
from pairloom.operators import curate, mix, order, sample, score
from tests.conftest import SMALL

KEY = ["a", "b"]


@pytest.fixture(scope="module")
def skewed(spark):
    """Three thousand rows; a third of them share one leading value."""
    a = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 101 * 1000)
    return spark.range(3000).select(a.alias("a"), F.col("id").alias("b"))


def md5(seed, *key):
    return hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 5])
def test_row_index(skewed, parts):
    indexed = order.with_row_index(skewed.repartition(parts), KEY)
    ranked = sorted(rows_of(skewed))
    assert {(a, b): i for a, b, i in rows_of(indexed.select("a", "b", "row_idx"))} == {
        k: i for i, k in enumerate(ranked)
    }


@pytest.mark.parametrize("n", [0, 1, 40, 999, 1040, 2999, 3000, 5000])
def test_first_n(skewed, n):
    found = order.first_n(skewed.repartition(3), n, KEY).select("row_idx", "a", "b")
    assert sorted(rows_of(found)) == [(i, *k) for i, k in enumerate(sorted(rows_of(skewed))[:n])]


def test_first_n_of_nothing(skewed):
    assert order.first_n(skewed.where("a < -1"), 5, KEY).count() == 0


def test_lookup_and_batches(skewed):
    ranked = sorted(rows_of(skewed))
    assert sorted(rows_of(order.lookup(skewed, [3, 1500], KEY).select("a", "b"))) == [
        ranked[3], ranked[1500]
    ]
    sizes = order.with_batch_id(skewed, 8, KEY).groupBy("batch_id").count()
    assert sizes.where("count != 8").count() == 0 and sizes.count() == 375


@pytest.mark.parametrize("n", [0, 1, 17, 1500, 3000, 9999])
def test_exact_sample(skewed, n):
    expected = sorted(rows_of(skewed), key=lambda k: md5(5, *k))[:n]
    for parts in (1, 4):
        drawn = sample.exact(skewed.repartition(parts), n, 5, KEY)
        assert sorted(rows_of(drawn)) == sorted(expected)


def test_bernoulli_and_split(skewed):
    expected = {k for k in rows_of(skewed) if int(md5(3, *k)[:8], 16) < int(0.25 * 2**32)}
    assert set(rows_of(sample.bernoulli(skewed, 0.25, 3, KEY))) == expected
    assert sample.bernoulli(skewed, 1.0, 3, KEY).count() == 3000
    assert sample.bernoulli(skewed, 0.0, 3, KEY).count() == 0
    split = sample.train_test(skewed, 0.25, 3, KEY)
    assert set(rows_of(split.where("split = 'test'").drop("split"))) == expected


def test_shuffle(skewed):
    expected = {k: i for i, k in enumerate(sorted(rows_of(skewed), key=lambda k: md5(9, *k)))}
    for parts in (1, 6):
        shuffled = sample.shuffle(skewed.repartition(parts), 9, KEY)
        assert {(a, b): i for a, b, i in rows_of(shuffled)} == expected


def test_mixtures(spark):
    reasoning = spark.range(100).select("id", F.lit("r").alias("origin"))
    chat = spark.range(1000, 1130).select("id", F.lit("c").alias("origin"))

    def counts(mode, share):
        mixed = mix.mixture(reasoning, chat, share, ["id"], mode)
        assert sorted(r.shuffle_pos for r in mixed.collect()) == list(range(mixed.count()))
        return {r[0]: r[1] for r in mixed.groupBy("origin").count().collect()}

    assert counts("reference", 0.75) == {"r": 100, "c": 25}
    assert counts("share", 0.75) == {"r": 43, "c": 130}
    assert counts("share", 0.5) == {"r": 100, "c": 100}


def pair(source, target):
    return (source, target)


RULES = {
    "sft": (curate.sft_rules, [
        ("天" * 100, "ア" * 100, "kept"), ("天" * 101, "ア", "too_long"), ("天", "ア" * 101, "too_long"),
        ("　 ", "ア", "blank"), ("天", "\n", "blank"), ("", "ア", "blank"), (None, "ア", "too_long"),
    ]),
    "seq2seq": (curate.seq2seq_rules, [
        ("天" * 80, "ア" * 80, "kept"), ("天" * 81, "ア", "too_long"), ("天", " ", "blank"),
    ]),
    "columnar": (curate.sft_columnar_rules, [
        ("天天天", "アアア", "kept"), ("天天", "アアア", "length"), ("天" * 81, "アアア", "length"),
        ("天天天", "ア" * 7 + "abc", "kept"), ("天天天", "ア" * 69 + "b" * 11, "kept"),
        ("天天天", "ア" * 6 + "abc", "purity"), ("天天天", "ア ア ア", "kept"), ("天天天", "   ", "purity"),
    ]),
    "profile": (curate.profile_rules, [
        ("天" * 5, "アアアアb", "kept"), ("天" * 4, "アアアアア", "length"), ("天" * 60, "ア" * 61, "length"),
        ("天" * 5, "アアアbb", "purity"), ("天" * 5, "アアアア。。。", "kept"), ("天" * 5, "。。。。。", "purity"),
    ]),
    "strict": (curate.strict_rules, [
        ("天地人", "アアアア。", "kept"), ("天地天", "アアア", "variety"), ("天地人", "アアア。", "purity"),
        ("天地人" * 14, "アアア", "length"), ("   ", "アアア", "blank"), ("天地人", "ア ア ア ア ア", "kept"),
    ]),
}


@pytest.mark.parametrize("name", RULES)
def test_rules_at_their_limits(spark, name):
    make, cases = RULES[name]
    frame = spark.createDataFrame(cases, "kanji_text string, katakana_text string, expected string")
    judged = frame.withColumn("reason", curate.drop_reason(make()))
    for row in judged.collect():
        assert row.reason == row.expected, row
    assert curate.keep(frame, make()).count() == sum(c[2] == "kept" for c in cases)


def test_observed_counts_equal_the_report(spark):
    frame = spark.createDataFrame(RULES["sft"][1], "kanji_text string, katakana_text string, expected string")
    seen = Observation()
    assert curate.keep_observed(frame, curate.sft_rules(), seen).count() == 1
    assert seen.get == {r.reason: r.n_rows for r in curate.report(frame, curate.sft_rules()).collect()}


def test_python_tokenizer_budget(spark):
    frame = spark.createDataFrame([("a b c",), ("a",), (None,)], "s string")
    kind = T.python_token_len(lambda: str.split)
    kept = curate.keep(frame, [curate.budget_rule(F.col("s"), 2, kind)])
    assert [r.s for r in kept.collect()] == ["a"]


def test_quantile_cut(spark):
    frame = spark.range(1, 12).select(F.col("id").alias("n"))
    kept = curate.keep_quantile(frame, F.col("n"), 0.9)
    assert kept.agg(F.max("n")).first()[0] == 10
    # 0.25 of the way from 1 to 11 is 3.5, cut to 3
    assert curate.keep_quantile(frame, F.col("n"), 0.25).agg(F.max("n")).first()[0] == 3


def test_plans_move_keys_only(skewed):
    """A sample filters its rows; only key histograms are exchanged."""
    wide = skewed.withColumn("text", F.repeat(F.lit("x"), 10))
    plan = sample.exact(wide, 10, 1, KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]


def test_first_n_keeps_null_and_text_keys(spark):
    rows = [(None,), (None,), (3,), (4,), (5,)]
    frame = spark.createDataFrame(rows, "k long").repartition(3)
    assert sorted(rows_of(order.first_n(frame, 3, ["k"])), key=str) == sorted([(None, 0), (None, 1), (3, 2)], key=str)
    assert order.first_n(frame.where("k IS NULL"), 5, ["k"]).count() == 2
    words = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert sorted(rows_of(order.first_n(words, 2, ["k"])), key=str) == sorted([(None, 0), ("a", 1)], key=str)


def test_first_n_reads_once_and_writes_nothing(spark):
    plan = order.first_n(spark.range(100).toDF("a"), 7, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1 and "Exchange rangepartitioning" not in plan


def test_a_cap_that_grows_with_the_table_is_spread(spark):
    found = entry.queries()["cap_null_keys"](spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    assert sorted(r.row_idx for r in found.collect()) == list(range(found.where("lead IS NULL").count() + 20))


@pytest.mark.parametrize("n", [60, 150, 1_500, 2_999, 5_000])
def test_a_large_prefix_is_narrowed_first(skewed, monkeypatch, n):
    monkeypatch.setattr(order, "FEW", 50)
    monkeypatch.setattr(order, "SAMPLED", 100)
    wanted = sorted(rows_of(skewed))[:n]
    got = order.first_n(skewed.repartition(6), n, KEY)
    assert sorted((r.row_idx, r.a, r.b) for r in got.collect()) == [(k, *x) for k, x in enumerate(wanted)]
    left = order.at_or_before(skewed.repartition(6), n, KEY).count()
    assert n <= left <= max(4 * n, 400) or left == 3_000


def test_a_large_prefix_with_null_keys_and_ties(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 10)
    monkeypatch.setattr(order, "SAMPLED", 50)
    rows = [(None if k % 3 == 0 else "ab"[k % 2], k // 2 if k % 5 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(4)
    got = order.first_n(df, 400, KEY).collect()
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.row_idx)] == sorted(rows, key=key)[:400]
    same = spark.range(700).select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert order.first_n(same, 300, KEY).count() == 300


def test_sketched_quantile_is_within_its_error(spark):
    sizes = spark.range(40_000).select((F.col("id") * 7919 % 10_007).alias("size"), (F.col("id") % 3).alias("day"))
    days = [curate.size_sketch(sizes.where(F.col("day") == d), F.col("size")) for d in range(3)]
    kept_sketches = days[0].unionByName(days[1]).unionByName(days[2])
    for share in (0.1, 0.5, 0.9, 0.99):
        limit = curate.sketch_quantile(kept_sketches, share).first().limit
        rank = sizes.where(F.col("size") <= limit).count() / 40_000
        assert abs(rank - share) < 2.3 / curate.SKETCH_K**0.9
    exact = curate.keep_quantile(sizes, F.col("size"), 0.9).count()
    assert abs(curate.keep_sketched_quantile(sizes, F.col("size"), kept_sketches, 0.9).count() - exact) < 0.007 * 40_000
    by_day = curate.size_sketch(sizes, F.col("size"), ["day"])
    assert {r.day for r in curate.sketch_quantile(by_day, 0.9, ["day"]).collect()} == {0, 1, 2}
    empty = curate.size_sketch(sizes.limit(0), F.col("size"), ["day"])
    assert curate.sketch_quantile(empty, 0.9, ["day"]).collect() == []


def test_step_log(spark):
    rows = [(1, "p", 1.0, "ab"), (1, "p", 3.0, "abcd"), (1, "q", 5.0, ""), (2, "r", 0.0, "x"), (2, "r", 0.0, "xyz"), (None, "s", None, None)]
    df = spark.createDataFrame(rows, "step int, prompt string, reward double, completion string")
    got = [tuple(r) for r in score.step_log(df.where("step IS NOT NULL"), "step", ["prompt"], "reward", "completion").collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 3, 3.5, 1.414214, 1.5), (2, 1, 2, 0.0, 0.0, 2.0), (None, 3, 5, 2.333333, 0.707107, 1.666667)], key=str)
