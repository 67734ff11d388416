"""Every pipeline stage against a plain statement of its decisions, and the whole run."""

import inspect
import random
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm import decontam, hashed, quality, queries, toxicity
from pairloom.session import shared_dir
from tests.conftest import SMALL
from tests.llm.test_decontam import every_window
from tests.llm.test_packing import check
from tests.llm.test_shingles import plain_roots
from tests.llm.test_simhash import plain_components, plain_fingerprint

STAGES = dict(corpus_pipeline.STAGES)


def plain_toxicity(spark, docs):
    vocab, p = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    weight = {t: (w, v) for t, w, v in zip(vocab.tolist(), p["w"], p["v"], strict=True)}
    kept = []
    for r in docs.collect():
        own = [weight[t] for t in hashed.terms(r.text).tolist() if t in weight]
        z = p["b"][0] + sum(w for w, _ in own)
        z += sum(own[i][1] @ own[j][1] for i in range(len(own)) for j in range(i))
        kept += [r] * bool(z < 0)
    return kept


def plain_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    vocab, p = quality.fit(docs, labels, quality.grade_of(labels.quality, labels.toxic), 3)
    weight = dict(zip(vocab.tolist(), p["w"], strict=True))
    return [r for r in docs.collect() if sum(weight.get(t, 0) for t in hashed.terms(r.text, True).tolist()) >= p["first"][0]]


def plain_simhash(spark, docs):
    """One of each group that fingerprints of five-word shingles within three bits join, all pairs compared."""
    rows = docs.collect()
    roots = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text, 5) for r in rows])
    return [r for r, root in zip(rows, roots, strict=True) if r.doc_id == root]


def plain_decontamination(spark, docs):
    items = [(r.item_id, decontam.plain_words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = docs.collect()
    hit = {d for d, _ in every_window([(r.doc_id, r.text) for r in rows], items)}
    return [r for r in rows if r.doc_id not in hit]


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs
    plain = [plain_toxicity, plain_quality, plain_simhash, plain_decontamination]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        got = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert got.schema.simpleString() == first.schema.simpleString()
        assert sorted(got.collect()) == sorted(wanted(spark, docs)), name
        docs = got
    assert 0 < docs.count() < first.count()
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    lengths = [(r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect()]
    packed = STAGES["packing"](spark, docs, SMALL).collect()
    check(packed, lengths)
    assert sorted(entry.queries()["pipeline"](spark, SMALL).collect()) == sorted(packed)
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for f in STAGES.values())


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, name):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    rows = [tuple(r) for r in docs.collect()]
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, "", "en", "s", 0), (9_001, "", None, None, None),
             (9_002, " ".join(f"q{rng.randrange(9_999)}" for _ in range(50_000)), "en", "s", None)]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], docs.schema.simpleString()[7:-1].replace(":", " ") + ", fp int, score string")
    got = STAGES[name](spark, odd, SMALL)
    if name != "packing":
        assert got.columns == odd.columns
        assert set(got.collect()) <= set(odd.collect())
    found = [r.doc_id for r in got.collect()]
    assert 9_002 in found
    if name == "simhash":
        assert len([i for i in found if i is not None]) == len(set(found) - {None}) and found.count(None) == 0
    assert np.all([r is not None for r in found]) or name != "simhash"
    assert STAGES[name](spark, odd.limit(0), SMALL).collect() == []


def test_simhash_stage_links_fingerprints(spark):
    """Texts of all similarities: the stage's groups are those of the fingerprints, not of the sets."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(12)]
    for text in texts[:12]:
        for n in (1, 2, 4):
            said = text.split()
            for at in rng.sample(range(len(said)), n):
                said[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(said))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = plain_components(range(len(texts)), [plain_fingerprint(t, 5) for t in texts])
    assert sorted(r.doc_id for r in STAGES["simhash"](spark, df, SMALL).collect()) == sorted(set(roots))
    assert 12 < len(set(roots)) < len(texts) and sorted(set(roots)) != sorted(set(plain_roots(texts)))


@pytest.mark.parametrize("name", ["toxicity", "quality", "simhash", "decontamination", "packing"])
def test_small_tables_are_few_files(spark, name):
    """Tables of a few hundred rows don't get a file for every one of many shuffle partitions."""
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(40)) for _ in range(300)]
    texts += [f"{t} more" for t in texts[:40]] + texts[:40]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], docs.schema))
    docs = corpus_pipeline.written(docs.coalesce(2), "docs")
    folder = Path(shared_dir(spark))
    there = set(folder.glob("pairloom-*/*"))
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        corpus_pipeline.written(STAGES[name](spark, docs, SMALL), "result")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*"))) for p in set(folder.glob("pairloom-*/*")) - there}
    assert "result" in files and max(files.values()) <= 8, files


def test_groups_without_ids(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (None, text), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = STAGES["simhash"](spark, df, SMALL).collect()
    assert sorted(got, key=str) == sorted([(1, "a b c d e"), (None, text)], key=str)


def test_ids_of_several_texts(spark):
    a, b = "one two three four five six", "a b c d e f g"
    for rows, wanted in (
        ([(5, a), (5, b)], [(5, a), (5, b)]),
        ([(3, b), (5, a), (5, b)], [(3, b), (5, a)]),
        ([(5, a), (5, a), (7, a), (7, b), (None, b)], [(5, a), (7, b)]),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, STAGES["simhash"](spark, df, SMALL).collect())) == sorted(wanted)
