"""Counts over the code points of texts, a whole Arrow batch at a time.

A pass over a text by regular expression costs about as much for each class, phrase or
character as all of these counts together, so what rewards count many times is counted here:
the batch's characters become one NumPy array, in pieces of a bounded size, and every count
is a table look-up and a histogram over it. NULL texts give NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 17  # bytes of text that are looked at together; a longer text is a piece of its own
CELLS = 1 << 17  # counters that are held at once
_ALL = 0x110000

Ranges = tuple[tuple[int, int], ...]


def _pieces(texts: pa.Array, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, bounds of the rows among them), piece by piece."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + piece, side="right")) - 1)
        raw = bytes(data[at[start]:at[end]]) if data is not None else b""
        try:
            text, sizes = raw.decode(), lengths[start:end]
        except UnicodeDecodeError:  # bytes that are no text; each row is read alone
            own = at[start:end + 1] - at[start]
            rows = [raw[a:b].decode(errors="replace") for a, b in zip(own[:-1], own[1:], strict=True)]
            text, sizes = "".join(rows), [len(r) for r in rows]
        bounds = np.zeros(end - start + 1, dtype=np.int64)
        np.cumsum(sizes, out=bounds[1:])
        yield start, np.frombuffer(text.encode("utf-32-le"), np.uint32), bounds
        start = end


def _runs(points: Iterable[int]) -> Ranges:
    """Code points as ranges (first, one past the last)."""
    own = np.unique(np.fromiter(points, np.int64))
    cuts = np.flatnonzero(np.diff(own) > 1) + 1
    return tuple((int(r[0]), int(r[-1]) + 1) for r in np.split(own, cuts) if len(r))


@lru_cache(8)
def _table(kinds: tuple[Ranges, ...]) -> np.ndarray:
    """For every code point the number of the kind it is of, from 1 on, or 0; kept in the worker."""
    found = np.zeros(_ALL, dtype=np.uint8 if len(kinds) < 256 else np.uint32)
    for i, ranges in enumerate(kinds):
        for first, end in ranges:
            found[first:end] = i + 1
    return found


def _of_kinds(points: np.ndarray, bounds: np.ndarray, kinds: tuple[Ranges, ...]) -> np.ndarray:
    """Characters of each row (down) and kind (across)."""
    n, size = len(bounds) - 1, len(kinds) + 1
    cell = np.repeat(np.arange(n) * size, np.diff(bounds)) + _table(kinds)[points]
    return np.bincount(cell, minlength=n * size).reshape(n, size)[:, 1:]


def _apart(at: np.ndarray, size: int) -> np.ndarray:
    """Which of the occurrences at these places don't overlap an earlier one."""
    kept, end = np.zeros(len(at), dtype=bool), -1
    for i, x in enumerate(at.tolist()):
        if x >= end:
            kept[i], end = True, x + size
    return kept


def _of_phrases(points: np.ndarray, bounds: np.ndarray, phrases: Sequence[str]) -> np.ndarray:
    """Occurrences of all phrases in each row, each counted on its own and without overlaps."""
    by_first: dict[int, list[str]] = {}
    for p in phrases:
        by_first.setdefault(ord(p[0]), []).append(p)
    n = len(bounds) - 1
    kind = _table(tuple(((p, p + 1),) for p in by_first))[points]
    places = np.flatnonzero(kind)
    kind = kind[places]
    rows = np.searchsorted(bounds, places, side="right") - 1
    room = bounds[rows + 1] - places
    owners = []
    for i, same in enumerate(by_first.values()):
        mine = np.flatnonzero(kind == i + 1)
        for p in same if len(mine) else ():
            hit = mine[room[mine] >= len(p)]
            for j in range(1, len(p)):
                hit = hit[points[places[hit] + j] == ord(p[j])]
            if any(p.startswith(p[k:]) for k in range(1, len(p))):
                hit = hit[_apart(places[hit], len(p))]
            owners.append(rows[hit])
    return np.bincount(np.concatenate(owners) if owners else places[:0], minlength=n)


def _above(points: np.ndarray, bounds: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Distinct characters of each row that it holds more than its limit of times."""
    out = np.zeros(len(limit), dtype=np.int64)
    rows = np.flatnonzero(np.diff(bounds) > limit)  # the others hold no character that often
    if not len(rows):
        return out
    distinct = np.unique(points)
    number = np.zeros(int(distinct[-1]) + 1, dtype=np.int64)
    number[distinct] = np.arange(len(distinct))
    step = max(1, CELLS // len(distinct))
    for s in range(0, len(rows), step):
        some = rows[s:s + step]
        sizes = bounds[some + 1] - bounds[some]
        place = np.arange(sizes.sum()) + np.repeat(bounds[some] - (np.cumsum(sizes) - sizes), sizes)
        cell = number[points[place]] + np.repeat(np.arange(len(some)) * len(distinct), sizes)
        counts = np.bincount(cell, minlength=len(some) * len(distinct)).reshape(len(some), -1)
        out[some] = ((counts > limit[some, None]) & (counts > 0)).sum(axis=1)
    return out


def _distinct(points: np.ndarray, bounds: np.ndarray, most: int) -> np.ndarray:
    """Distinct characters of each row other than ASCII spaces, up to ``most``.

    Most rows show enough of them at the start; only the others are looked at in full.
    """
    head = np.minimum(np.diff(bounds), 32)
    at = np.minimum(bounds[:-1, None] + np.arange(32), max(len(points) - 1, 0))
    first = points[at].astype(np.int64) if len(points) else np.full(at.shape, -1)
    first[(np.arange(32) >= head[:, None]) | (first == 32)] = -1
    first.sort(axis=1)
    new = np.diff(first, axis=1, prepend=-1) != 0
    out = (new & (first >= 0)).sum(axis=1)
    for r in np.flatnonzero((out < most) & (np.diff(bounds) > 32)):
        row = points[bounds[r]:bounds[r + 1]]
        found, left = 0, row[row != 32]
        while found < most and len(left):
            found, left = found + 1, left[left != left[0]]
        out[r] = found
    return np.minimum(out, most)


def scan(
    s: Column, kinds: Mapping[str, Iterable[int]] | None = None,
    phrases: Mapping[str, Sequence[str]] | None = None, distinct: Mapping[str, int] | None = None,
    limits: Mapping[str, Column] | None = None, piece: int = PIECE,
) -> Column:
    """Struct of counts over the characters of a text, all made in one pass.

    A field per kind has the number of its characters (kinds share none), a field per list of
    phrases their occurrences, each phrase on its own, a field of ``distinct`` the number of distinct
    characters but for ASCII spaces, up to the number given, and a field per limit the number of
    distinct characters that occur more often than that. A NULL limit gives NULL.
    """
    phrases, distinct, limits = dict(phrases or {}), dict(distinct or {}), dict(limits or {})
    names, ranges = list(kinds or {}), tuple(_runs(k) for k in (kinds or {}).values())
    fields = [*names, *phrases, *distinct, *limits]

    def count(texts: pa.Array, *given: pa.Array) -> pa.Array:
        bound = [g.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for g in given]
        out = np.zeros((len(fields), len(texts)), dtype=np.int32)
        for start, points, bounds in _pieces(texts, piece):
            end = start + len(bounds) - 1
            if names:
                out[:len(names), start:end] = _of_kinds(points, bounds, ranges).T
            for i, p in enumerate(phrases.values(), len(names)):
                out[i, start:end] = _of_phrases(points, bounds, p)
            for i, most in enumerate(distinct.values(), len(names) + len(phrases)):
                out[i, start:end] = _distinct(points, bounds, most)
            for i, b in enumerate(bound, len(fields) - len(bound)):
                out[i, start:end] = _above(points, bounds, b[start:end])
        nulls = [texts.is_null()] * (len(fields) - len(given)) + [pc.or_(texts.is_null(), g.is_null()) for g in given]
        masks = [x.to_numpy(zero_copy_only=False) for x in nulls]
        return pa.StructArray.from_arrays([pa.array(o, pa.int32(), mask=m) for o, m in zip(out, masks, strict=True)], fields)

    counted = F.arrow_udf(count, f"struct<{','.join(f'{f}:int' for f in fields)}>")
    return counted(s, *(b.cast("bigint") for b in limits.values()))
