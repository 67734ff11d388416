"""URL rules and perspectives: DuckDB checks and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.llm import perspectives, urls
from tests.conftest import SMALL
from tests.oracle import compare

RULE_SCHEMA = "host string, path string, verdict string"


@pytest.mark.parametrize("name", ["op5_url_filters", "op7_chat_perspectives"])
def test_query(spark, duck, name):
    run = entry.queries()[name]
    assert compare(spark, duck, SMALL, run, entry.oracle_sql()[name]) == []
    plan = run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_rule(rules, url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [
        (len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    _, _, _, rule, verdict = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, rule, verdict


def test_urls_against_plain_rules(spark):
    rng = random.Random(1)
    labels, parts = ["a", "b", "net", "example", "", "é"], ["en", "de", "", "x.html", "e"]
    rules = [(".".join(rng.choice(labels[:4]) for _ in range(rng.randint(1, 3))),
              rng.choice(["", "/", "/en", "/en/", "/en/de/", "/e", "/de//", None]), rng.choice(["block", "allow"]))
             for _ in range(40)]
    rules += [(None, "/", "block"), ("", "", "block"), rules[0]]
    found = [None, "", "no scheme", "http://", "http://a.net", "HTTP://A.NET/", "http://a.net?x=/en/", "x://y://z/",
             "http://a.net/en/#/de", "http://a.net/" + "en/" * 20_000, "http://" + "a." * 20_000 + "net/", "h://É.net/"]
    for _ in range(300):
        found.append("http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) + "".join(
            "/" + rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(["", "?q=/", "#f"]))
    rows = [(rng.randrange(50), u, "h", "r", "d") for u in [*found, *found[:30]]]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, digest string")
    got = urls.judge(pages, spark.createDataFrame(rules, RULE_SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], *plain_rule(rules, r[1])) for r in rows), key=str)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, RULE_SCHEMA)).collect() == []
    none = urls.judge(pages, spark.createDataFrame([], RULE_SCHEMA))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_perspectives(spark):
    rows = [(1, t, r, x, 9) for t, r, x in [
        (0, "system", "be kind"), (1, "ann", "hi <|im_end|>"), (2, "bob", None), (2, "ann", "tie"), (2, "ann", "tie"),
        (700, "cy\nd", "far"), (None, None, "first"), (5000, "ann", "x" * 100_000)]]
    rows += [(2, 0, "system", "alone", 9), (None, 0, "eve", "lost", 9), (None, 0, "eve", "lost", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head long")
    got = perspectives.rotate(df).collect()
    views = {}
    for r in sorted(got, key=lambda r: r.position):
        views.setdefault((r.conv_id, r.participant), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "cy\nd"), (1, "unknown"), (None, "eve")}
    for (_, who), segments in views.items():
        assert [r.position for r in segments] == list(range(len(segments)))
        whole = "".join(r.text for r in segments)
        for r in segments:
            assert whole[r.start:r.stop] == r.text
            assert r.text.count("<|im_end|>") == 1
            if r.speaker == who:
                said = next(x[3] or "" for x in rows if (x[0], x[1]) == (r.conv_id, r.turn) and (x[2] or "unknown") == who)
                assert whole[r.loss_start:r.loss_stop] == said.replace("<|", "< |") + "<|im_end|>\n"
                assert r.role == "assistant" and r.text.startswith("<|im_start|>assistant\n")
            else:
                assert r.loss_start is None and r.loss_stop is None
    ann = views[1, "ann"]
    assert [r.speaker for r in ann] == ["unknown", "system", "ann", "ann", "bob", "cy\nd", "ann"]
    assert ann[5].text == "<|im_start|>user name=cy d\nfar<|im_end|>\n"
    assert perspectives.rotate(df.limit(0)).collect() == []


def test_a_hot_turn_number_is_split(spark):
    rng = random.Random(8)
    rows = [(None, rng.choice([None, 0, 1]), rng.choice(["ann", "bob", "system"]), f"t{k:04} " + "x" * rng.randrange(9)) for k in range(3_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        said = turns.select(F.col("conv_id").alias("conv"), "turn", F.col("role").alias("speaker"), "text").repartition(4)
        sizes = [r["count"] for r in perspectives.in_order(said).groupBy("chunk").count().collect()]
        got = perspectives.rotate(turns).where("participant = 'ann'").orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3_000 and max(sizes) < 2_000
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert [r.position for r in got] == list(range(3_000))
    assert [(r.turn, r.speaker) for r in got] == [r[1:3] for r in ordered]
    at = 0
    for r, wanted in zip(got, ordered, strict=True):
        assert wanted[3] in r.text and (r.start, r.stop) == (at, at + len(r.text))
        at = r.stop
