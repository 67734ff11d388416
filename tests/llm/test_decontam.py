"""Benchmark search against brute force."""

import random
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from pairloom.llm import decontam
from tests.conftest import SMALL


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def every_window(docs, items):
    """Pairs and similarities, all passages against all windows."""
    out = {}
    passages = [decontam.Passage(i, w, None) for i, w in items]
    for doc_id, text in docs:
        said = decontam.plain_words(text)
        for first in range(0, max(len(said) - decontam.STRIDE, 1), decontam.STRIDE):
            for p in passages:
                n = len(p.words)
                share = p.similarity(said[max(0, first - n):first + decontam.WINDOW + n])
                if share > out.get((doc_id, p.item), 0):
                    out[doc_id, p.item] = share
    return out


def test_bit_parallel_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice(b"abcde") for _ in range(rng.randint(1, 40))] for _ in range(2))
        p = decontam.Passage(0, a, None)
        assert decontam.common_length(p.masks, len(a), b) == longest_common(a, b)


def test_query_finds_what_every_window_shows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, decontam.plain_words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wanted = every_window(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in entry.queries()["op8_benchmark_decontamination"](spark, SMALL).collect()}
    assert wanted and set(got) <= set(wanted)
    assert len(got) >= 0.98 * len(wanted)
    exact = {pair for pair, share in wanted.items() if share == 1}
    assert exact <= set(got)


def invented(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_odd_rows_paraphrases_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4_000)]
    items = [(k, invented(rng, rng.choice([5, 15, 40, 150]), words), f"w{k}") for k in range(30)]
    items += [(30, None, None), (31, "too few words", None), (None, invented(rng, 20, words), None), items[4], (99, items[5][1], None)]
    docs, wanted = [], set()
    for k, text, _ in items[:30]:
        said = text.split()
        filler = invented(rng, rng.randint(0, 300), words), invented(rng, rng.randint(0, 300), words)
        changed = [w if i % 9 else "swap" for i, w in enumerate(said)] if len(said) > 30 else said
        docs.append((k, f"{filler[0]} {' '.join(changed).upper()}, {filler[1]}"))
        wanted.add((k, k))
        if k == 5:
            wanted.add((5, 99))
    half = items[2][1].split()
    docs += [(100, None), (101, ""), (102, "w1"), (None, items[3][1]), (103, invented(rng, 60_000, words)), docs[0], docs[0]]
    wanted.add((None, 3))
    df = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, item string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert found == wanted, (found ^ wanted, half)
    monkeypatch.setattr(decontam, "BLOCK", 8)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == wanted
    assert decontam.leaks(df.limit(0), bench).collect() == []
    assert decontam.leaks(df, bench.limit(0)).collect() == []


def test_answer_settles_paraphrases():
    item = [b"q%d" % k for k in range(20)]
    said = [w for k, w in enumerate(item) if k % 3] + [b"forty", b"two"]
    assert decontam.Passage(1, item, None).similarity(said) == 0
    assert decontam.Passage(1, item, b"forty two").similarity(said) == 13 / 20
    assert decontam.Passage(1, item, b"forty three").similarity(said) == 0


def test_basis_spans_the_rows(spark):
    rng = np.random.default_rng(1)
    at = [rng.integers(0, 60, 12).tolist() for _ in range(20)]
    weights = rng.uniform(1, 2, 60)
    v = decontam.basis(spark.createDataFrame([(a,) for a in at], "at array<long>"), weights, rank=30)
    rows = np.zeros((20, 60))
    for k, a in enumerate(at):
        np.add.at(rows[k], a, weights[a])
    assert np.allclose(rows @ v @ v.T, rows, atol=1e-3)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-4)


def test_verbatim_items_beyond_the_rank(spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(30_000)]  # few words make up most of a text
    hot = invented(rng, 18, words)
    docs = [invented(rng, 120, words) for _ in range(300)]
    items = [(0, hot)] + [(k, invented(rng, rng.choice([5, 8, 12, 20, 40]), words)) for k in range(1, 1_100)]
    wanted = set()
    for d in range(300):
        said = docs[d].split()
        own = [items[k] for k in rng.sample(range(1, 1_100), 4)] + [items[0]] * (d % 3 == 0)
        for k, text in own:
            at = rng.randrange(len(said) + 1)
            said[at:at] = text.split()
            wanted.add((d, k, text))
        docs[d] = " ".join(said)
    wanted = {(d, k) for d, k, text in wanted if f" {text} " in f" {docs[d]} "}  # not cut by a later one
    assert len(wanted) > 1_000 and sum(k == 0 for _, k in wanted) > 80
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    missed = wanted - {(r.doc_id, r.item_id) for r in found.where("similarity = 1").collect()}
    assert not missed, (len(missed), len(wanted), sorted(missed)[:10])


def test_paraphrases_of_the_rarer_half(spark):
    """What the words and the answer accept is found, whichever words were replaced."""
    rng = random.Random(5)
    words = rng.choices([f"w{i}" for i in range(3_000)], [1 / (i + 10) for i in range(3_000)], k=30_000)
    count = Counter(words)
    docs, items, wanted = [], [], set()
    for k in range(1_000):
        said = [rng.choice(words) for _ in range(24)]
        answer = f"answer{k}" if k % 2 else None
        order = sorted(range(24), key=lambda i: count[said[i]]) if k % 4 < 2 else rng.sample(range(24), 24)
        gone = set(order[:11 if answer else 4])
        other = " ".join(rng.choice(words) if i in gone else w for i, w in enumerate(said))
        items.append((k, " ".join(said), answer))
        docs.append((k, f"{invented(rng, rng.randint(0, 200), words)} {other} {answer or ''} {invented(rng, rng.randint(0, 200), words)}"))
        wanted.add((k, k))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string, answer string"), answer_col="answer")
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert not wanted - found, (len(wanted - found), sorted(wanted - found)[:10])
    assert len(found - wanted) < 20


def test_short_items_are_phrases(spark):
    docs = [(1, "so they went Home, alone again"), (2, "home is where they are alone"), (3, None), (4, "alone"), (5, " ".join(["x"] * 500) + " went home")]
    items = [(1, "went home"), (2, "alone"), (3, "They went home alone"), (None, "home alone"), (4, ""), (5, "home went")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (1, None), (2, 2), (4, 2), (5, 1)}
    assert [r.doc_id for r in decontam.clean(df, bench).collect()] == [3]


def test_sums_of_products_by_groups_of_terms(spark, monkeypatch):
    monkeypatch.setattr(decontam, "TERMS", 7)
    test_basis_spans_the_rows(spark)
