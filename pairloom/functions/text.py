"""Script counts, purity ratios, stripping, number parsing and keyed hashing.

Lengths are code points. Counting compares a text with the text that ``regexp_replace``
leaves of it: that stays in generated code, while higher-order functions over characters
are interpreted. Several counts of one text are taken from a chain of remainders, so that
costly classes only see what the cheap ones left over; where there are many, ``points`` counts
all in one pass. Character classes use the
``\\x{...}`` spelling, which Java and RE2 both read.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import fixed, points


def _ranges(points):
    """Regex class text for ascending code points, runs above Latin-1 folded to ranges.

    Java tests single Latin-1 characters with one bit set, ranges one after the other.
    """
    runs = []
    for p in points:
        if runs and p == runs[-1][1] + 1 and p > 0xFF:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(
        f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs
    )


def _guarded(points):
    """Java class text: Latin-1 members, and the others behind one range test."""
    low = [p for p in points if p <= 0xFF]
    high = [p for p in points if p > 0xFF]
    return f"{_ranges(low)}[\\x{{{high[0]:X}}}-\\x{{{high[-1]:X}}}&&[{_ranges(high)}]]"


# Unicode white space as str.strip() and str.isspace() see it. The flat class is for
# engines without class intersection.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
FLAT_SPACE = _ranges(map(ord, SPACE_CHARS))
SPACE = _guarded(list(map(ord, SPACE_CHARS)))

KATAKANA = r"\x{30A0}-\x{30FF}"
MIDDLE_DOT = r"\x{30FB}"  # a punctuation mark inside the katakana block
KATAKANA_NO_DOT = r"\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}"
HIRAGANA = r"\x{3040}-\x{309F}"
KANJI = r"\x{4E00}-\x{9FAF}"
ASCII_LETTER = "a-zA-Z"
ASCII_DIGIT = "0-9"
# str.isdigit() also takes superscripts, circled digits and the like. Decimal digits
# beyond ASCII start at U+0660.
_OTHER_DIGITS = [p for p in range(0x20000) if chr(p).isdigit() and not chr(p).isdecimal()]
FLAT_DIGIT = r"\p{Nd}" + _ranges(_OTHER_DIGITS)
DIGIT = (
    f"0-9{_ranges(p for p in _OTHER_DIGITS if p <= 0xFF)}"
    rf"[\x{{660}}-\x{{1FFFF}}&&[\p{{Nd}}{_ranges(p for p in _OTHER_DIGITS if p > 0xFF)}]]"
)
ALNUM = r"\p{L}\p{N}"
PUNCTUATION = _ranges(sorted(map(ord, fixed.PUNCTUATION)))
SYMBOL = _ranges(sorted(map(ord, fixed.UNWANTED_SYMBOLS)))

# Kinds of characters that share none; the far ones may be decimal digits of other scripts.
KINDS = {
    "kata": [*range(0x30A0, 0x30FB), *range(0x30FC, 0x3100)], "dot": [0x30FB],
    "kanji": range(0x4E00, 0x9FB0), "hira": range(0x3040, 0x30A0),
    "letter": [*map(ord, string.ascii_letters)], "ascii_digit": [*map(ord, string.digits)],
    "low_digit": [p for p in _OTHER_DIGITS if p <= 0xFF],
    "symbol": [*map(ord, fixed.UNWANTED_SYMBOLS)], "blank": [0x20], "newline": [0x0A],
    "space": [ord(c) for c in SPACE_CHARS if c not in " \n"],
    "mark": [ord(c) for c in fixed.PUNCTUATION if c != "・"],
    "far": sorted({*range(0x660, 0x3000), *range(0x3100, 0x4E00), *range(0x9FB0, 0x20000)}
                  - {*map(ord, SPACE_CHARS + fixed.PUNCTUATION)}),
}

# Bytes per character where all members of a class are equally long in UTF-8.
_UTF8_BYTES = {
    KATAKANA: 3, KATAKANA_NO_DOT: 3, MIDDLE_DOT: 3, HIRAGANA: 3, KANJI: 3, PUNCTUATION: 3,
    ASCII_LETTER: 1, ASCII_DIGIT: 1, SYMBOL: 1, " ": 1, r"\n": 1,
}

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_DIGITS = "[0-9](?:_?[0-9])*"
_PYTHON_FLOAT = rf"^[+-]?({_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
# The decimal digits of all scripts, each run of ten from zero on.
_WIDE_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None)
_THEIR_ASCII = "".join(str(unicodedata.decimal(c)) for c in _WIDE_DIGITS)

_NUMERIC = rf"({_FLOAT})|^[+-]?(?i:inf|infinity)$"


def strip(s: Column) -> Column:
    """Trim Unicode white space; ``trim`` alone only knows U+0020."""
    return F.btrim(s, F.lit(SPACE_CHARS))


def is_blank(s: Column) -> Column:
    return F.length(strip(s)) == 0


def remove(s: Column, char_class: str) -> Column:
    """The text without the characters of a regex character class."""
    return F.regexp_replace(s, f"[{char_class}]+", "")


def n_removed(before: Column, after: Column, char_class: str) -> Column:
    """Number of characters ``remove`` took away.

    Byte lengths are stored with the text, character lengths have to be counted, so bytes
    are compared where the class allows it.
    """
    width = _UTF8_BYTES.get(char_class)
    if width is None:
        return F.length(before) - F.length(after)
    gone = F.octet_length(before) - F.octet_length(after)
    return gone if width == 1 else (gone / F.lit(width)).cast("int")


def count_class(s: Column, char_class: str) -> Column:
    """Number of characters of ``s`` in a regex character class."""
    return n_removed(s, remove(s, char_class), char_class)


def _no_common(s: Column) -> Column:
    """What is left without kana, kanji and ASCII letters: spaces, digits, marks."""
    return remove(remove(s, KATAKANA), KANJI + HIRAGANA + ASCII_LETTER)


def nonspace_length(s: Column) -> Column:
    return F.length(s) - count_class(_no_common(s), SPACE)


def no_ascii_space(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def count_phrase(s: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    gone = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(phrase), F.lit("")))
    width = len(phrase.encode())
    return gone if width == 1 else (gone / F.lit(width)).cast("int")


def count_phrases(s: Column, phrases: Sequence[str]) -> Column:
    """Occurrences of all phrases, each counted on its own."""
    return points.scan(s, phrases={"n": phrases})["n"]


def _script_counts(s: Column) -> list[Column]:
    counts, rest = [], s
    for name, char_class in (
        ("katakana", KATAKANA), ("hiragana", HIRAGANA), ("kanji", KANJI),
        ("english", ASCII_LETTER), ("numbers", DIGIT),
    ):
        left = remove(rest, char_class)
        counts.append(n_removed(rest, left, char_class).alias(name))
        rest = left
    return counts


def script_counts(s: Column) -> Column:
    """Struct of katakana, hiragana, kanji, ASCII letters and digits."""
    return F.struct(*_script_counts(s))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def japanese_total(s: Column) -> Column:
    """Characters that count towards the profile ratio; the classes do not overlap."""
    return F.length(s) - F.length(remove(_no_common(s), DIGIT))


def profile_ratio(s: Column) -> Column:
    """Katakana share among letters and digits; punctuation is ignored."""
    return ratio(count_class(s, KATAKANA), japanese_total(s))


def script_profile(s: Column, variant: str = "default") -> Column:
    """Script counts with totals and katakana share.

    ``fast`` adds every alphanumeric to the total a second time, so a fully converted
    text scores about one half. It is kept as a named variant because reports made with
    it must stay reproducible.
    """
    counts = _script_counts(s)
    if variant == "default":
        total = japanese_total(s)
    elif variant == "fast":
        counts = counts[:3]
        total = sum(counts, F.lit(0)) + count_class(s, ALNUM)
    else:
        raise ValueError(f"unknown profile variant: {variant}")
    return F.struct(
        *counts,
        total.alias("japanese_total"),
        ratio(count_class(s, KATAKANA), total).alias("katakana_ratio"),
        F.length(s).alias("total_length"),
    )


def inline_total(s: Column) -> Column:
    """Kana, kanji and alphanumerics, each counted once."""
    return F.length(s) - F.length(remove(_no_common(s), ALNUM))


def inline_ratio(s: Column) -> Column:
    """Katakana share among kana, kanji and alphanumerics; punctuation is ignored."""
    return ratio(count_class(s, KATAKANA), inline_total(s))


def purity_nonspace(s: Column) -> Column:
    """Katakana share among non-space characters; NULL where there are none."""
    return F.try_divide(count_class(s, KATAKANA), nonspace_length(s))


def purity_length(s: Column) -> Column:
    """Katakana over length without ASCII spaces."""
    return ratio(count_class(s, KATAKANA), F.length(no_ascii_space(s)))


def length_ratio(result: Column, source: Column) -> Column:
    """len(result) / len(source), 0 where the source is empty."""
    return F.coalesce(F.try_divide(F.length(result), F.length(source)), F.lit(0.0))


def distinct_chars(s: Column) -> Column:
    return F.array_distinct(F.split(s, ""))


def n_distinct_chars(s: Column) -> Column:
    """Number of distinct characters; the empty string has none."""
    return F.when(F.length(s) == 0, 0).otherwise(F.size(distinct_chars(s)))


def fewer_distinct(s: Column, n: int) -> Column:
    """True if ``s`` has less than ``n`` distinct characters, ASCII spaces aside."""
    return points.scan(s, distinct={"n": n})["n"] < n


def n_chars_above(s: Column, limit: Column) -> Column:
    """Number of distinct characters that occur in ``s`` more than ``limit`` times."""
    return points.scan(s, limits={"n": limit})["n"]


def parse_float(s: Column) -> Column:
    """Number in a text as Python's ``float`` reads it, NULL where it is none.

    Decimal digits of any script count, and single underscores between digits. A plain cast
    would take ``1d`` and ``1f``, so the text must look like a number first.
    """
    t = strip(s)
    t = F.when(t.rlike("[^\\x00-\\x7f]"), F.translate(t, _WIDE_DIGITS, _THEIR_ASCII)).otherwise(t)
    low = F.lower(t)
    return (
        F.when(t.rlike(_PYTHON_FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        .when(low.rlike(r"^\+?(inf|infinity)$"), F.lit(float("inf")))
        .when(low.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
        .when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def is_number(s: Column) -> Column:
    """True for numeric text, infinities included, NaN and NULL excluded."""
    return F.coalesce(strip(s).rlike(_NUMERIC), F.lit(False))


def digest(seed, *keys: Column) -> Column:
    """Hex MD5 of ``seed:key:key...``: a uniform, partitioning-independent row hash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def below_rate(hashed: Column, rate: float) -> Column:
    """True for a ``rate`` share of digests; compares hex text, so nothing is parsed."""
    if rate >= 1.0:
        return F.lit(True)
    return F.substring(hashed, 1, 8) < F.lit(f"{int(rate * 2**32):08x}")


def preview(s: Column, width: int) -> Column:
    return F.when(
        F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))
    ).otherwise(s)


def token_len(s: Column, kind="chars") -> Column:
    """Length of a text in tokens: ``chars``, ``words`` or any Column function."""
    if callable(kind):
        return kind(s)
    if kind == "chars":
        return F.length(s)
    if kind == "words":
        t = strip(s)
        return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, f"[{SPACE}]+")))
    raise ValueError(f"unknown token kind: {kind}")


_LOADED: dict[str, Any] = {}


def once_per_worker(token: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for later tasks of the same Python worker under ``token``."""
    if token not in _LOADED:
        _LOADED[token] = make()
    return _LOADED[token]


def python_token_len(make_encode: Callable[[], Callable[[str], Sequence]]) -> Callable:
    """Token length by a Python tokenizer, for use as ``kind`` of ``token_len``.

    ``make_encode`` runs once per Python worker, so a tokenizer is loaded there and not
    shipped; texts arrive in Arrow batches.
    """
    token = uuid.uuid4().hex

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = once_per_worker(token, make_encode)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return size
