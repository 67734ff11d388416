"""Token ids of documents in files of independent, checksummed zstandard frames.

A file holds, after another:

* data frames: little-endian unsigned 32-bit ids of whole documents, FRAME bytes or a little
  more before compression (a longer document has a frame of its own);
* a skippable frame with the document table: id, tokens before it in the file, tokens;
* the seek table of the zstandard seekable format, also a skippable frame: compressed size,
  decompressed size and checksum (low 32 bits of XXH64) of every data frame.

Any zstandard reader sees the ids in order; ``read_document`` reads one document's frame only.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import written
from pairloom.session import fresh_path

FRAME = 1 << 20  # bytes of ids in a frame
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the public format
DOCUMENTS = 0x184D2A50  # skippable frame of the document table
CHECKSUM = 0x80  # flag: the seek table has checksums
_TABLE = np.dtype([("id", "<i8"), ("start", "<u8"), ("n", "<u8"), ("has_id", "u1")])
_SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
CACHE = 200_000  # words that a worker remembers
_GROUP = 64  # words that are encoded in one call's text
_HELD = 1 << 20  # characters of texts that are encoded together
_ROWS = 1_000  # documents that are read together

# letters, then ASCII marks but ' and <; the first part may hold numbers such as a superscript, which are not letters
MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:;=-@\[-`{-~]+)")

_encoders: dict[str, Encoder] = {}  # one per tokenizer file and worker


class Encoder:
    """Ids of texts by a tokenizers file, each distinct word encoded once.

    Only for tokenizers that drop white space and mark the end of words, as
    ``word_bpe_49k.json`` does: no merge, special token or normalization then reaches across
    a blank or line feed, so ids of the pieces between them are the ids of the text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without normalization and patterns, for words that these leave alone
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str], light: bool = False) -> list[np.ndarray]:
        tokenizer = self.light if light else self.tokenizer
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of all pieces. Letters share calls, with a word end for each piece.

        A word of letters has one end and never fewer; if a call gives as many as it has words,
        the cuts between them are known. Letters before a run of marks are a word by themselves.
        """
        known = self.known
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        split = [
            (p, m.group(1), m.group(2)) for p in others
            if (m := MARKED.fullmatch(p)) and m.group(1).isalpha() and _is_latin(p)
        ]
        composed = {p for p, _, _ in split}
        marks = {x for _, _, x in split}
        words += {x for _, x, _ in split}.difference(known, words)
        lower, other = [], []
        for w in words:
            (lower if w.islower() and _is_latin(w) else other).append(w)
        for some, light in ((lower, True), (other, False)):
            groups = [some[i:i + _GROUP] for i in range(0, len(some), _GROUP)]
            for group, ids in zip(groups, self._whole([" ".join(g) for g in groups], light), strict=True):
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(group):
                    data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                    known.update((w, data[at[k]:at[k + 1]]) for k, w in enumerate(group))
        rest = list({*marks, *other, *(p for p in others if p not in composed)}.difference(known))
        known.update(zip(rest, (ids.tobytes() for ids in self._whole(rest)), strict=True))
        known.update((p, known[word] + known[run]) for p, word, run in split)

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; words are looked up for about _HELD characters of texts at once."""
        held, size = [], 0
        for text in texts:
            held.append(_pieces(text or ""))
            size += len(text or "")
            if size >= _HELD:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn(list(set().union(*texts).difference(self.known)))
        get = self.known.__getitem__
        for pieces in texts:
            yield b"".join(map(get, pieces))


def _pieces(text: str) -> list[str]:
    if "<" not in text and _is_latin(text):
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def _is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1, where lower-casing goes letter by letter."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI or absolute path."""
    uri = re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class Writer:
    """Writes one file; documents are added in order."""

    def __init__(self, stream, frame: int = FRAME) -> None:
        self.stream, self.frame = stream, frame
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting: list[bytes] = []
        self.size = self.tokens = 0
        self.seek: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.documents.append((doc_id or 0, self.tokens, n, doc_id is not None))
        self.tokens += n
        if self.size and self.size + len(ids) > self.frame:
            self._flush()
        for at in range(0, len(ids), self.frame):  # a long document takes frames of its own
            self.waiting.append(ids[at:at + self.frame])
            self.size += len(self.waiting[-1])
            if self.size >= self.frame:
                self._flush()

    def _flush(self) -> None:
        plain = b"".join(self.waiting)
        self.waiting, self.size = [], 0
        if plain:
            packed = self.compressor.compress(plain)
            self.stream.write(packed)
            self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        table = np.array(self.documents, dtype=_TABLE).tobytes()
        self.stream.write(struct.pack("<II", DOCUMENTS, len(table)) + table)
        self.seek.append((8 + len(table), 0, xxhash.xxh64_intdigest(table) & 0xFFFFFFFF))
        seek = np.array(self.seek, dtype=_SEEK).tobytes()
        foot = struct.pack("<IBI", len(self.seek), CHECKSUM, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(seek) + len(foot)) + seek + foot)
        self.stream.close()


class Reader:
    """Reads one file through its tables; a frame is decompressed when one of its documents is asked for."""

    def __init__(self, stream) -> None:
        self.stream, size = stream, stream.size()
        n, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUM:
            raise ValueError("not a file of this format: no seek table with checksums at its end")
        self.seek = np.frombuffer(self._bytes(size - 9 - n * _SEEK.itemsize, n * _SEEK.itemsize), dtype=_SEEK)
        self.at = np.concatenate(([0], np.cumsum(self.seek["packed"], dtype=np.int64)))
        self.plain = np.concatenate(([0], np.cumsum(self.seek["plain"], dtype=np.int64)))
        table = self._bytes(self.at[-2] + 8, self.at[-1] - self.at[-2] - 8)
        self._check(n - 1, table)
        self.documents = np.frombuffer(table, dtype=_TABLE)
        self.held: tuple[int, bytes] = (-1, b"")

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(int(at))
        return self.stream.read(int(n))

    def _check(self, k: int, data: bytes) -> None:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} fails its checksum")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            packed = self._bytes(self.at[k], self.seek["packed"][k])
            plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.seek["plain"][k]))
            self._check(k, plain)
            self.held = (k, plain)
        return self.held[1]

    def read_document(self, row: int) -> tuple[int | None, bytes]:
        """Id and token ids of the document in a row of the table."""
        doc_id, start, n, has_id = self.documents[row].tolist()
        at, stop, parts = 4 * start, 4 * (start + n), []
        k = int(np.searchsorted(self.plain, at, "right")) - 1
        while at < stop:
            data = self.frame(k)[at - self.plain[k]:stop - self.plain[k]]
            parts.append(data)
            at, k = at + len(data), k + 1
        return (doc_id if has_id else None), b"".join(parts)

    def read_documents(self) -> Iterator[bytes]:
        """Token ids of all documents in order; every frame is decompressed once."""
        plain, at, k = b"", 0, 0  # the bytes at hand, the place in them, the next frame
        for n in (4 * self.documents["n"].astype(np.int64)).tolist():
            if at + n > len(plain):
                parts, size = [plain[at:]], len(plain) - at
                while size < n:
                    parts.append(self.frame(k))
                    size, k = size + len(parts[-1]), k + 1
                plain, at = b"".join(parts), 0
            yield plain[at:at + n]
            at += n


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          frame: int = FRAME) -> DataFrame:
    """Write the token files of ``docs`` in ascending id order; a written table (part, file, documents, tokens).

    Ids are sorted with nulls first, equal ids by the hash of their text. Every task attempt
    writes a file of its own name, the table has those of the attempts that ended well; other
    files belong to nobody. Null and empty texts are documents of the end id alone, an empty
    table gives no file. Only id and text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        writer, uri = None, f"{folder}/{uuid.uuid4().hex}.zst"
        encode_all, end = encoder(tokenizer).encode_all, struct.pack("<I", end_id)
        for b in batches:
            for i, ids in zip(b["id"], encode_all(b["text"]), strict=True):
                if writer is None:
                    system, path = _open(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(path, compression=None), frame)
                writer.add(None if pd.isna(i) else int(i), ids + end)
        if writer:
            writer.close()
            yield pd.DataFrame({
                "part": [TaskContext.get().partitionId()], "file": [uri], "documents": [len(writer.documents)],
                "tokens": [writer.tokens],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(parts.mapInPandas(run, "part int, file string, documents long, tokens long"), "token_files")


def read(files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the files of such a table, in any order.

    ``start`` counts the ids of all documents before; ``ids`` are their bytes in the file, left
    out if not asked for. Every file is read by a task of its own.
    """
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    n = files.count()
    files = files.select("part", "file", F.coalesce(F.sum("tokens").over(ordered), F.lit(0)).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, before in zip(b["file"], b["before"], strict=True):
                system, path = _open(uri)
                with system.open_input_file(path) as stream:
                    reader = Reader(stream)
                    at = 0
                    for held in _held(reader.read_documents()):
                        own = reader.documents[at:at + len(held)]
                        at += len(held)
                        out = {
                            "doc_id": pd.arrays.IntegerArray(own["id"].astype(np.int64), own["has_id"] == 0),
                            "start": own["start"].astype(np.int64) + before, "n_tokens": own["n"].astype(np.int64),
                            "ids_crc32": np.fromiter(map(crc32, held), dtype=np.int64, count=len(held)),
                        }
                        yield pd.DataFrame(out | ({"ids": held} if ids else {}))

    # a stated number of partitions is kept, where one for each file name would be merged
    return files.repartition(max(n, 1)).mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    )


def _held(documents: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Documents in lists of about _ROWS, shorter where they are long."""
    held, size = [], 0
    for data in documents:
        held.append(data)
        size += len(data)
        if len(held) >= _ROWS or size >= 4 * _HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the documents as the written files have them."""
    files = write(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    return read(files, ids=False)
