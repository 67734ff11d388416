"""Importance resampling against a plain statement of it."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import xxhash

import __spark_entry__ as entry
from pairloom.llm import resampling
from tests.conftest import SMALL

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def bucket(f):
    return crc32(f.encode()) % 10_000


def plain(docs, target, percent=25, least=20):
    """Sorted (doc_id, n_features, weight, score, rank) of (id, text) rows."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, rows in ((s, [x for _, x in docs]), (t, target)):
        for text in rows:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    n_s, n_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (n_s + 10_000) / ((a + 1) * (n_t + 10_000)))) for a, b in zip(s, t)]
    out, drawn = [], []
    for k, (i, text) in enumerate(docs):
        w, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        drawn += [k] * (len(w) >= least)
    order = sorted(drawn, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(order[:percent * len(drawn) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


def test_query_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = entry.queries()["op13_target_resampling"](spark, SMALL)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "A", "b1", "ß", "é", "日本", "x_y", "don't", "1.5", "\x7f", "\x00", "É"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(None, "a b " * 20), (None, None), (5, ""), (6, None), (7, "?!"), rows[3], rows[3],
             (99, " ".join(f"w{rng.randrange(500)}" for _ in range(40_000))), (100, "y" * 200_000)]
    df = spark.createDataFrame([(2, i, t, "x") for i, t in rows], "rank int, doc_id long, text string, score string")
    target = spark.createDataFrame([("a b A",), (None,), ("日本 é",)], "text string")
    wanted = plain(rows, ["a b A", None, "日本 é"])
    for held in (1 << 16, 7):
        monkeypatch.setattr(resampling, "HELD", held)
        assert sorted(map(tuple, resampling.resample(df, target).collect()), key=str) == wanted
    none = resampling.resample(df, target.limit(0)).collect()
    assert sorted(map(tuple, none), key=str) == plain(rows, [])
    assert resampling.resample(df.limit(0), target).collect() == []


def test_equal_keys_of_different_strings(monkeypatch):
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 70))) for _ in range(300)]
    strings += [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    data, first = b"".join(strings), np.cumsum([0, *map(len, strings)])[:-1]
    size = np.array(list(map(len, strings)))
    by_library = [xxhash.xxh64_intdigest(x, 42) for x in strings]
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    assert resampling.hashes(data, raw, first, size).tolist() == by_library
    fakes = (by_library, [len(x) % 3 for x in strings], [2**64 - 1] * len(strings))
    for fake in fakes:
        monkeypatch.setattr(resampling, "hashes", lambda *_, fake=fake: np.array(fake, dtype=np.uint64))
        table = resampling.Table(data, first, size)
        by_slot = {}
        for s, x in zip(table.slot.tolist(), strings):
            assert by_slot.setdefault(s, x) == x
        assert len(by_slot) == len(set(strings)) == len(table.used)
        for s, x in by_slot.items():
            assert table.count[s] == strings.count(x) and table.bucket[s] == crc32(x) % 10_000
