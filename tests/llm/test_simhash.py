"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pandas as pd
import xxhash

import __spark_entry__ as entry
from pairloom.llm import golay, simhash
from pairloom.llm.components import components
from tests.conftest import SMALL

SCHEMA = "id long, fp long, doc_id string, text string, key long"


def plain_fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(shingle, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def compare(rows, ids, texts, id_col="doc_id"):
    fps = [plain_fingerprint(t) for t in texts]
    wanted = sorted(
        zip(ids, (f"{f:016x}" for f in fps), plain_components(ids, fps), strict=True), key=str
    )
    got = sorted(((r[id_col], r.fingerprint, r.component_id) for r in rows.collect()), key=str)
    assert got == wanted


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = entry.queries()["op1_simhash_near_dedup"](spark, SMALL)
    compare(rows, [r.doc_id for r in docs], [r.text for r in docs])


def test_golay_code():
    words = golay.decode(np.arange(1 << 23))
    assert (np.bincount(words) == 2048).all()  # perfect: equal spheres cover all words
    _, valid = golay.nearby(np.arange(0, 1 << 23, 37))
    assert set(valid.sum(axis=1)) == {1, 6}


def test_keys_of_close_fingerprints_meet():
    rng = random.Random(5)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        rows = simhash.key_rows(np.array([x, y], dtype=np.uint64).view(np.int64))
        a, b = (set(zip(g.key, g.side, strict=True)) for _, g in rows.groupby("fp"))
        assert any((k, {0: 0, 1: 2, 2: 1}[s]) in b for k, s in a)


def test_odd_rows(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", *base, *base, "x " * 70_000, "É é", "a\xa0b c d"]
    texts += [t.replace("w1", "v1", 1) for t in base]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 3)]
    rows = [(1, 2, i, t, 3) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "id long, fp long, doc_id long, text string, key long")
    compare(simhash.near_duplicates(df), ids, texts)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_large_keys_are_dealt(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    for bucket in (50, 20_000):
        links = simhash.links(df, bucket)
        assert all((a ^ b & (1 << 64) - 1).bit_count() <= 64 for a, b in links.collect())
        assert components(links).groupBy("root").count().select("count").collect() == [(780,)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 200)] + [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(40)]
    links += [(None, 3), (9, None), (700, 700), *[(900, 901 + i) for i in range(300)]]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
