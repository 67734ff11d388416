"""Near-duplicates by Jaccard similarity against all pairs of texts."""

import random

from pairloom.llm import shingles, simhash
from tests.conftest import SMALL


def plain_set(text):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(min(5, len(w))))))


def plain_roots(texts):
    own, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.one_of_each(df, shingle=5, similarity=0.8).collect())


def test_copies_with_some_edits_go(spark):
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    for text in texts[:60]:
        said = text.split()
        for share in (0.004, 0.01, 0.02):
            texts.append(" ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in said))
    texts += ["", None, "one", "ONE", "a b c d", "a b c d e"]
    roots = plain_roots(texts)
    assert kept(spark, texts) == sorted(set(roots))
    assert len(set(roots)) < len(texts) - 100


def test_groups_that_the_smallest_set_does_not_join(spark):
    rng = random.Random(12)
    chain, texts = [f"c{i}" for i in range(200)], []
    for k in range(40):  # each text is near its neighbours, not near those further off
        texts.append(" ".join([*chain[k * 4:], *(f"n{i}" for i in range(k * 4))]))
    line = " ".join(f"hot{i}" for i in range(8))
    texts += [" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(40)), line]) for _ in range(30)]
    roots = plain_roots(texts)
    assert kept(spark, texts) == sorted(set(roots))
    assert len(set(roots[:40])) == 1


def test_odd_similarity_of_exactly_the_bound(spark):
    base = [f"w{i}" for i in range(22)]  # 18 shingles; without the last 4 words 14 of 18, without 3 15 of 18
    texts = [" ".join(base), " ".join(base[:-4]), " ".join(f"v{i}" for i in range(24)), " ".join(f"v{i}" for i in range(20))]
    assert kept(spark, texts) == sorted(set(plain_roots(texts))) == [0, 1, 2]
    assert shingles.signature("") == shingles.signature(None) == 0
