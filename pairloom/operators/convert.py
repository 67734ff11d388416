"""Batch conversion with a user-supplied converter."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from pairloom.functions import fixed
from pairloom.functions.text import once_per_worker

Converter = Callable[[list[str]], list[str]]
RESULT = ty.StructType([
    ty.StructField("output", ty.StringType()),
    ty.StructField("seconds", ty.DoubleType()),
    ty.StructField("error", ty.StringType()),
])


NULL_TEXT = "no text"


def _one_by_one(convert: Converter, texts: list[str]):
    """Results of a batch that failed as a whole: only the guilty rows keep an error."""
    for text in texts:
        started = time.perf_counter()
        try:
            yield convert([text])[0], time.perf_counter() - started, None
        except Exception as problem:  # the converter is foreign code
            yield f"{fixed.ERROR_PREFIX}{problem}", 0.0, str(problem)


def _convert_batch(convert: Converter, texts: list[str | None]):
    """Results in order; only texts that are there reach the converter."""
    given = iter(_convert_texts(convert, [t for t in texts if t is not None]))
    missing = (f"{fixed.ERROR_PREFIX}{NULL_TEXT}", 0.0, NULL_TEXT)
    return [missing if t is None else next(given) for t in texts]


def _convert_texts(convert: Converter, texts: list[str]):
    if not texts:
        return []
    started = time.perf_counter()
    try:
        outputs = convert(texts)
        if len(outputs) != len(texts):
            raise ValueError(f"{len(outputs)} outputs for {len(texts)} texts")
    except Exception:
        return list(_one_by_one(convert, texts))
    each = (time.perf_counter() - started) / len(texts)
    return [(o, each, None) for o in outputs]


def batch_convert(
    df: DataFrame, text: str, make_converter: Callable[[], Converter], batch_size: int = 8
) -> DataFrame:
    """Add ``output``, ``seconds`` and ``error`` by converting ``text`` in small batches.

    ``make_converter`` runs once per Python worker, so a model is loaded there and not
    shipped. Only ``batch_size`` texts are handed over at a time. A NULL
    text is an error of its row.
    """

    token = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = once_per_worker(token, make_converter)
        for frame in frames:
            results = []
            texts = frame[text].tolist()
            for at in range(0, len(texts), batch_size):
                batch = texts[at:at + batch_size]
                results.extend(_convert_batch(convert, batch))
            yield frame.assign(
                output=[r[0] for r in results],
                seconds=[r[1] for r in results],
                error=[r[2] for r in results],
            )

    return df.mapInPandas(run, ty.StructType(df.schema.fields + RESULT.fields))


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema, batch_size: int = 1000
) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``batch_size`` rows.

    For foreign code that works on lists; ``schema`` describes what it returns.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                batch = frame.iloc[at:at + batch_size]
                yield pd.DataFrame(fn({c: batch[c].tolist() for c in batch.columns}))

    return df.mapInPandas(run, schema)


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull())
