"""Foreign code: loaded once per worker, called by keyword, never with NULL."""

import os
import uuid

from pyspark.sql import functions as F

from pairloom.functions import rewards
from pairloom.functions import text as T
from pairloom.operators import convert


def counted(folder, result):
    """A loader that leaves a file each time it runs."""

    def load():
        (folder / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return result

    return load


def loads_per_worker(folder):
    owners = [f.name.split("-")[0] for f in folder.iterdir()]
    return len(owners), len(set(owners))


def test_converter_is_loaded_once_per_worker(spark, tmp_path):
    texts = spark.range(200).select(F.col("id").cast("string").alias("t")).repartition(50)
    done = convert.batch_convert(texts, "t", counted(tmp_path, lambda batch: [t + "!" for t in batch]))
    assert sorted(r.output for r in done.collect()) == sorted(f"{i}!" for i in range(200))
    loads, workers = loads_per_worker(tmp_path)
    assert loads == workers < 50


def test_tokenizer_is_loaded_once_per_worker(spark, tmp_path):
    size = T.python_token_len(counted(tmp_path, str.split))
    rows = spark.range(200).select(F.lit("a b c").alias("t")).repartition(50).select(size("t").alias("n"))
    assert {r.n for r in rows.collect()} == {3}
    loads, workers = loads_per_worker(tmp_path)
    assert loads == workers < 50


def test_null_texts_never_reach_the_converter(spark):
    def convert_all(batch):
        assert None not in batch
        return [t.upper() for t in batch]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "k int, t string").coalesce(1)
    got = {r.k: (r.output, r.error) for r in convert.batch_convert(rows, "t", lambda: convert_all, 2).collect()}
    assert got[1] == ("A", None) and got[3] == ("B", None)
    assert got[2][1] == got[4][1] == convert.NULL_TEXT


def test_rewards_by_keyword_see_whole_message_lists(spark):
    message = "array<struct<role string, content string>>"
    rows = [([("system", "s"), ("user", "q")], [("assistant", "abc")], "7", 2), ([("user", "q")], [], None, 3)]
    frame = spark.createDataFrame(rows, f"prompts {message}, completions {message}, answer string, weight int")
    columns = {c: F.col(c) for c in frame.columns}

    def by_length(completions, **kwargs):
        return [len(c[0]["content"]) * w if c else -1 for c, w in zip(completions, kwargs["weight"], strict=True)]

    def by_answer(prompts, completions, answer, **kwargs):
        return [len(p) + (a is not None) for p, a in zip(prompts, answer, strict=True)]

    got = frame.select(
        rewards.python_reward(by_length)(**columns).alias("a"), rewards.python_reward(by_answer)(**columns).alias("b"),
        rewards.python_pair_reward(lambda p, r: len(p + r))(**columns).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [(6.0, 3.0, 4.0), (-1.0, 1.0, 1.0)]
