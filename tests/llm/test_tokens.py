"""Token files: exact round trip, ids equal to whole-text encoding, damage is seen."""

import io
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

import __spark_entry__ as entry
from pairloom.llm import tokens
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, rows):
    """(doc_id, start, n_tokens, crc) of (id, text) rows in order."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_matches_whole_text_encoding(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = entry.queries()["op2_token_files"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == plain(tokenizer, docs)


def test_pieces_have_the_ids_of_the_text(tokenizer):
    rng = random.Random(1)
    marks = ["a", "É", "é", "İ", "ﬁ", "'s", "don't", "x'S.", "<|endoftext|>", "<|ENDOFTEXT|>", "1.5", "日本", "Σας", " ",
             "\t", "\r", "\x1c", " ", "...", ",", "word.", "WORD,", "ß", "ʼn.", "🎉", "̸", "a̸", "ª.", "Ⅷ", "�", ""]
    own = tokens.Encoder(PATH)
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    for _ in range(300):
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40))
        assert list(np.frombuffer(own.encode(text), dtype="<u4")) == tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(400):
        text = "".join(rng.choice(marks) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randint(0, 30)))
        assert list(np.frombuffer(own.encode(text), dtype="<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_numbers_and_marks_beside_letters(tokenizer, seed):
    """Many strings at once and one by one, in an order of their own for every seed."""
    rng = random.Random(seed)
    latin = [chr(c) for c in range(33, 256)]
    kinds = [list("²³¹¼½¾ªºµ.,;:!?()-_"), [*"aeioukméßÆ", *"²³¼ªº.,"], latin, [*"αβγΣσςΆΐab²., "], list("ab'<|>.²\u0301\u0307Åİ")]
    own, texts = tokens.Encoder(PATH), []
    for _ in range(8_000):
        kind = rng.choice(kinds)
        texts.append("".join(rng.choice(kind) if rng.random() < 0.9 else rng.choice([" ", "\n", "\xa0"]) for _ in range(rng.randint(1, 12))))
    texts += ["It has 50 km².", "m²,", "cm³.", "café³;", "km²", "km.", "x²."]
    rng.shuffle(texts)
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    half = len(texts) // 2
    got = [*own.encode_all(texts[:half]), *(own.encode(t) for t in texts[half:])]
    wrong = [t for t, g, w in zip(texts, got, wanted, strict=True) if np.frombuffer(g, dtype="<u4").tolist() != w]
    assert not wrong, wrong[:10]


def test_odd_rows(spark, tokenizer):
    rows = [(5, "b b"), (None, "no id"), (3, None), (9, ""), (3, "tie"), (3, "tie"), (-7, "x " * 50_000), (8, "퟿ é")]
    df = spark.createDataFrame([(1, i, t, 2) for i, t in rows], "start long, doc_id long, text string, file int")
    got = sorted(tokens.round_trip(df, PATH, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -7, 3, 3, 3, 5, 8, 9]
    crcs = sorted(r.ids_crc32 for r in got)
    assert crcs == sorted(w[3] for w in plain(tokenizer, rows))
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == list(starts[:-1])
    assert tokens.round_trip(df.limit(0), PATH, 2).collect() == []


def test_every_file_is_read_by_its_own_task(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"words of document {i} " * (1 + i % 7 * 40)) for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokens.write(docs, str(tmp_path / "t"), PATH, 2, frame=4_096)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = files.count()
    back = tokens.read(files)
    assert n > 2 and back.rdd.getNumPartitions() == n
    for r in back.collect():
        assert crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
    assert sorted(r.doc_id for r in back.collect()) == list(range(400))


def file_of(documents, frame):
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = tokens.Writer(sink, frame)
    for i, ids in documents:
        writer.add(i, ids)
    writer.close()
    return sink.getvalue()


def test_format():
    rng = np.random.default_rng(1)
    documents = [(i, rng.integers(0, 49_408, n, dtype=np.uint32).tobytes()) for i, n in enumerate([3, 0, 500, 70, 2_000, 1])]
    documents += [(None, b"\x01\0\0\0"), (-4, b"")]
    data = file_of(documents, frame=1_024)
    plain_bytes = b"".join(x for _, x in documents)
    unpacked = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert unpacked == plain_bytes  # any reader skips the tables
    reader = tokens.Reader(pa.PythonFile(io.BytesIO(data), mode="r"))
    assert len(reader.seek) > 8
    for k in reversed(range(len(documents))):
        assert reader.read_document(k) == documents[k]
    assert list(reader.read_documents()) == [x for _, x in documents]
    asked = []
    fresh = tokens.Reader(pa.PythonFile(io.BytesIO(data), mode="r"))
    whole = fresh.frame
    fresh.frame = lambda k: asked.append(k) or whole(k)
    fresh.read_document(0)
    assert asked == [0]
    damaged = bytearray(data)
    damaged[int(reader.at[1]) + 9] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken = tokens.Reader(pa.PythonFile(io.BytesIO(bytes(damaged)), mode="r"))
        for k in range(len(documents)):
            broken.read_document(k)
    with pytest.raises(ValueError):
        tokens.Reader(pa.PythonFile(io.BytesIO(data[:-3]), mode="r"))
