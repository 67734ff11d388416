"""Packing: whole, within capacity, and as item-by-item best-fit packs."""

import random
from collections import defaultdict

from tokenizers import Tokenizer

import __spark_entry__ as entry
from pairloom.llm import packing, queries
from tests.conftest import SMALL


def check(rows, lengths, sizes=packing.SIZES):
    """Every token of every document once, no overlap, smallest permitted capacity."""
    covered, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.bin_id is None:
            assert r.n_tokens == 0
            continue
        covered[r.doc_id].append((r.first_token, r.n_tokens))
        bins[r.bin_id].append((r.start, r.n_tokens, r.capacity))
    wanted = defaultdict(list)
    for i, n in lengths:
        for at in range(0, n or 0, sizes[-1]):
            wanted[i].append((at, min(sizes[-1], n - at)))
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(v) for k, v in wanted.items()}
    for items in bins.values():
        at = 0
        for start, n, capacity in sorted(items):
            assert start == at
            at += n
        assert {c for _, _, c in items} == {min(s for s in sizes if s >= at)}
    return bins


def one_by_one(lengths, sizes, prefer):
    """Spaces left of best-fit decreasing, item by item, always opening ``prefer`` if it fits."""
    open_bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in open_bins if b[1] >= n]
        if fits:
            min(fits, key=lambda b: b[1])[1] -= n
        else:
            size = prefer if prefer >= n else min(s for s in sizes if s >= n)
            open_bins.append([size, size - n])
    return sorted(map(tuple, open_bins))


def test_counts_pack_like_items():
    rng = random.Random(1)
    sizes = (16, 32, 64)
    for _ in range(60):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 20]) for _ in range(rng.randint(1, 120))]
        histogram = {n: lengths.count(n) for n in lengths}
        got = packing.plan(histogram, sizes, prefer=64)
        used = [size - left for size, left in one_by_one(lengths, sizes, 64)]
        wanted = sorted(min(s for s in sizes if s >= u) for u in used)
        assert sorted(s for _, n, s in got.bins for _ in range(n)) == wanted
        best = packing.best_plan(histogram, sizes)
        assert best.cost <= min(packing.plan(histogram, sizes, p).cost for p in (None, *sizes))


def test_query(spark):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    lengths = [(r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs]
    bins = check(entry.queries()["op4_best_fit_packing"](spark, SMALL).collect(), lengths)
    filled = sum(n for items in bins.values() for _, n, _ in items) / sum(items[0][2] for items in bins.values())
    assert filled > 0.97


def test_odd_rows(spark):
    rng = random.Random(2)
    lengths = [(i, rng.choice([7, 100, 512, 513, rng.randint(1, 9_000)])) for i in range(300)]
    lengths += [(1_000 + i, 333) for i in range(500)]
    lengths += [(5, 7), (5, 7), (None, 9), (7, None), (8, 0), (9, -4), (10, 100_000)]
    df = spark.createDataFrame([(2, i, n, 3, 4) for i, n in lengths], "id long, doc_id long, n_tokens long, bin_id int, salt int")
    got = packing.pack(df, salts=8).collect()
    check(got, [(i, n) for i, n in lengths if n is None or n > 0])
    assert sorted(r.doc_id for r in got if r.bin_id is None) == [7, 8, 9]
    assert packing.pack(df.limit(0)).collect() == []
