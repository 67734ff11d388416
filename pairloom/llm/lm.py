"""Language-model scores of texts: a hashed maximum-entropy model with classes of words.

P(word | before) = P(class | before) * P(word | class). A word's class is a hash of its first
two bytes, so words never seen have one too; the end of a text is a class of its own. The
class comes from a softmax over sums of weight rows: one row for each feature of the words
before, which are n-grams (the word before, its class, the last two classes) and skips (the
second and third class before), hashed into a fixed table. Within a class, words have their
add-one frequencies, unknown words share one count.

Training: every task makes gradient steps over its documents from the common weights, and the
weights are averaged by tokens, in ROUNDS over disjoint shares that make up all training rows.
Counts: the COMMON most frequent words go to the tasks, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import words, written

CLASSES = 64  # the last is the end of a text
TABLE = 4_096  # rows for hashed words, and for hashed pairs of classes
END = b" "  # no word holds a blank
COMMON = 1 << 17
ROUNDS = 2
WARM = 8  # the first round takes one row in so many
RATE, CALM = 0.15, 1.0
STEP = 2_048  # tokens of a gradient step, and of a batch that is scored
PIECE = 200_000  # tokens of texts held at once, or one text
SLICES, FAN = 64, 64  # parts of the weights that are summed apart, and sums before the last

_BOS = CLASSES
_SPAN = CLASSES + 1
ROWS = 1 + 3 * _SPAN + 2 * TABLE


def class_of(word: bytes) -> int:
    return CLASSES - 1 if word == END else crc32(word[:2]) % (CLASSES - 1)


class Lexicon(dict):
    """Numbers of the distinct words met, given on first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self), dtype=np.uint64, count=len(self)).view(np.int64)

    def classes(self) -> np.ndarray:
        return np.fromiter(map(class_of, self), dtype=np.int64, count=len(self))


def pieces(texts: Iterator[str | None]) -> Iterator[tuple[Lexicon, np.ndarray, np.ndarray]]:
    """Texts a piece at a time: distinct words, their numbers token by token, first token of each text."""
    lexicon, numbers, starts, size = Lexicon(), [], [0], 0
    for text in texts:
        said = words(text)
        said.append(END)
        numbers.append(np.fromiter(map(lexicon.__getitem__, said), dtype=np.int64, count=len(said)))
        size += len(said)
        starts.append(size)
        if size >= PIECE:
            yield lexicon, np.concatenate(numbers), np.array(starts)
            lexicon, numbers, starts, size = Lexicon(), [], [0], 0
    if numbers:
        yield lexicon, np.concatenate(numbers), np.array(starts)


def features(lexicon: Lexicon, classes: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weight rows (features x tokens) of what stands before each token; the bias row 0 is left out."""
    sizes = np.diff(starts)
    place = np.arange(len(numbers), dtype=np.int32) - np.repeat(starts[:-1].astype(np.int32), sizes)
    said = classes[numbers]

    def back(values: np.ndarray, k: int, none: int) -> np.ndarray:
        moved = np.concatenate((np.full(k, none, dtype=values.dtype), values))[:len(values)]
        moved[place < k] = none
        return moved

    one, two, three = (back(said, k, _BOS) for k in (1, 2, 3))
    word = np.fromiter((crc32(w, 3) % TABLE for w in lexicon), dtype=np.int64, count=len(lexicon))
    pair = (one * _SPAN + two) * 2_654_435_761 % (1 << 32) * TABLE >> 32
    return np.stack((
        1 + one, 1 + _SPAN + two, 1 + 2 * _SPAN + three, 1 + 3 * _SPAN + back(word[numbers], 1, 0),
        1 + 3 * _SPAN + TABLE + pair,
    )).astype(np.int16)  # short numbers are sorted by radix


def chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax over the classes of each token."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += weights[0]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, said: np.ndarray) -> None:
    """One Adagrad step on the log likelihood of the classes ``said``."""
    error = chances(weights, rows)
    error[np.arange(len(said)), said] -= 1
    sums = [(np.zeros(1, dtype=np.int64), error.sum(axis=0, keepdims=True))]
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sums.append((ordered[first], np.add.reduceat(error[order], first, axis=0)))
    for at, slope in sums:
        squares[at] += slope * slope
        weights[at] -= RATE * slope / np.sqrt(squares[at])


class Learner:
    """Gradient steps from common weights over pieces of texts."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.tokens = weights.copy(), 0
        self.squares = np.full(weights.shape, CALM, dtype=np.float32)

    def learn(self, lexicon: Lexicon, classes: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> None:
        rows, said = features(lexicon, classes, numbers, starts), classes[numbers]
        for s in range(0, len(said), STEP):
            step(self.weights, self.squares, rows[:, s:s + STEP], said[s:s + STEP])
        self.tokens += len(said)


def train(rows: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Class weights, and the table (h, cls, c) of every word's hash, class and count; each row is read once."""
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    share = F.pmod(F.xxhash64("text"), F.lit(WARM))
    schema = "h long, cls int, n long, slice int, fan int, part binary"
    counted = []
    for turn in range(ROUNDS):
        own = rows.where(share == 0 if turn == 0 else share != 0)
        sent = rows.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            learner = Learner(sent.value)
            for b in batches:
                for lexicon, numbers, starts in pieces(b["text"]):
                    classes = lexicon.classes()
                    learner.learn(lexicon, classes, numbers, starts)
                    yield pd.DataFrame({
                        "h": lexicon.hashes(), "cls": classes, "n": np.bincount(numbers, minlength=len(lexicon)),
                        "slice": -1, "fan": 0, "part": None,
                    })
            if learner.tokens:
                parts = np.array_split((learner.weights * learner.tokens).ravel(), SLICES)
                yield pd.DataFrame({
                    "h": 0, "cls": 0, "n": learner.tokens, "slice": range(SLICES),
                    "fan": TaskContext.get().partitionId() % FAN, "part": [p.astype(np.float32).tobytes() for p in parts],
                })

        learnt = written(own.select("text").mapInPandas(run, schema), "learnt")
        counted.append(learnt.where("slice < 0").select("h", "cls", "n"))
        models = learnt.where("slice >= 0").select("slice", "fan", "n", "part")
        for fan in (F.col("fan"), F.lit(0)):
            models = models.withColumn("fan", fan).groupBy("slice", "fan").applyInPandas(_sum, models.schema)
        got = models.orderBy("slice").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["part"], dtype=np.float32) / r["n"] for r in got])
            weights = flat.reshape(weights.shape).astype(np.float32)
    words_seen = reduce(DataFrame.unionByName, counted).groupBy("h", "cls").agg(F.sum("n").alias("c"))
    return weights, written(words_seen, "word_counts")


def _sum(parts: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, dtype=np.float32) for p in parts["part"])
    return parts.iloc[:1][["slice", "fan"]].assign(n=parts["n"].sum(), part=[total.tobytes()])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words (A-Z lower-cased, cut at blank and the controls 9 to 13) and one end.
    Rows with CRC(id as text) mod ``folds`` = ``fold`` are held out; the others, also those
    with null id, train. ``base_score`` is the log10 probability by add-one word frequencies
    with one more word for all unknown ones, ``score`` the model's. Null texts are empty:
    their end alone is scored. Repeated rows are learnt and scored each. An empty table gives
    an empty result; only id and text are read. Words are told apart by their 64-bit hash.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    weights, counts = train(training)
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    room = np.ones(CLASSES)  # tokens and words of each class, and its unknown word
    for r in counts.groupBy("cls").agg((F.sum("c") + F.count("*")).alias("n")).collect():
        room[r["cls"]] += r["n"]
    common = counts.orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toPandas().sort_values("h")
    sent = docs.sparkSession.sparkContext.broadcast((
        weights, np.log10(room), common["h"].to_numpy(dtype=np.int64), common["c"].to_numpy(dtype=np.int64)
    ))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        weights, log_room, known, c = sent.value
        for b in batches:
            at = 0
            for lexicon, numbers, starts in pieces(b["text"]):
                n = len(starts) - 1
                classes, hashes = lexicon.classes(), lexicon.hashes()
                said, all_rows = classes[numbers], features(lexicon, classes, numbers, starts)
                score = -log_room[said]
                for s in range(0, len(said), STEP):
                    p = chances(weights, all_rows[:, s:s + STEP])
                    score[s:s + STEP] += np.log10(np.maximum(p[np.arange(len(p)), said[s:s + STEP]], 1e-30))
                spot = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                is_common = known[spot] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                logs = np.where(is_common, np.log10(c[spot] + 1), 0.0) if len(known) else np.zeros(len(hashes))
                rest = [
                    hashes[own[~is_common[own]]] for own in np.split(numbers, starts[1:-1])
                ]
                yield pd.DataFrame({
                    "key": np.arange(key, key + n), "id": b["id"].iloc[at:at + n].to_numpy(),
                    "held_out": b["held_out"].iloc[at:at + n].to_numpy(), "n_tokens": np.diff(starts),
                    "model": np.add.reduceat(score, starts[:-1]), "log": np.add.reduceat(logs[numbers], starts[:-1]),
                    "known": np.add.reduceat(is_common[numbers].astype(np.int64), starts[:-1]), "rest": rest,
                }).astype({"id": "Int64"})
                at, key = at + n, key + n

    scored = written(rows.mapInPandas(
        run, "key long, id long, held_out boolean, n_tokens long, model double, log double, known long, rest array<long>"
    ), "scored")
    rare = scored.select("key", F.explode("rest").alias("h")).groupBy("key", "h").agg(F.count("*").alias("n"))
    found = rare.join(counts.select("h", "c"), "h").groupBy("key").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known")
    )
    word_log = F.col("log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rest").join(found, "key", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (word_log - F.col("n_tokens") * F.lit(float(np.log10(tokens + vocabulary + 1)))).alias("base_score"),
        (F.col("model") + word_log).alias("score"),
    )
