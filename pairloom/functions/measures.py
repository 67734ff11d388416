"""Named measurements of prompt and response that rewards share.

A reward asks for measures by name; each becomes one column, computed once per row no
matter how many rewards and score steps use it. Written as one expression per reward the
same passes would be repeated in every ``CASE`` branch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, points, tags
from pairloom.functions import text as T

_SCAN = "_scan"


class Measures:
    """Measures requested so far, in layers that build on each other."""

    def __init__(self, prompt: Column, response: Column, answer: Column):
        self._columns = {"prompt": prompt, "response": response, "answer": answer}
        self._used: dict[str, set[str]] = {n: set() for n in self._columns}
        self._asking: list[set[str]] = []
        self._scans: dict[str, dict[str, dict]] = {}

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            self._asking.append(set())
            column = MEASURES[name](self)
            self._used[name] = self._asking.pop()
            self._columns[name] = column
        if self._asking:
            self._asking[-1].add(name)
        return F.col(_stored(name))

    def scan(self, text: str, part: str, asked: Mapping) -> Column:
        """Struct of counts over a text's characters; what is asked for later joins the same pass."""
        name = text + _SCAN
        parts = self._scans.setdefault(text, {})
        parts[part] = parts.get(part, {}) | asked
        self._asking.append(set())
        bound = {k: self[limit] for k, limit in parts.get("limits", {}).items()}
        self._columns[name] = points.scan(self[text], parts.get("kinds"), parts.get("phrases"), parts.get("distinct"), bound)
        self._used[name] = self._asking.pop()
        if self._asking:
            self._asking[-1].add(name)
        return F.col(_stored(name))

    def _layer(self, name: str, found: dict[str, int]) -> int:
        if name not in found:
            found[name] = 1 + max((self._layer(u, found) for u in self._used[name]), default=-1)
        return found[name]

    def _scanned(self, name: str) -> bool:
        return name.endswith(_SCAN) or any(map(self._scanned, self._used[name]))

    def add_to(self, df: DataFrame) -> DataFrame:
        """The table with a column per requested measure.

        Scans run after all measures that don't need them, so no text but theirs is held meanwhile.
        """
        early = [n for n in self._columns if not self._scanned(n)]
        found: dict[str, int] = {}
        last = max(self._layer(n, found) for n in early)
        found |= {n: last + 1 for n in self._columns if n.endswith(_SCAN)}
        layers = {n: self._layer(n, found) for n in self._columns}
        for layer in range(1 + max(layers.values())):
            names = [n for n, at in layers.items() if at == layer]
            df = df.withColumns({_stored(n): self._columns[n] for n in names}) if names else df
        return df

    def drop_from(self, df: DataFrame) -> DataFrame:
        return df.drop(*map(_stored, self._columns))


def _stored(name: str) -> str:
    return f"_m_{name}"


def _kind(*names: str, text: str = "resp") -> Callable[[Measures], Column]:
    """Characters of these kinds."""

    def counted(m: Measures) -> Column:
        counts = m.scan(text, "kinds", T.KINDS)
        return sum((counts[n] for n in names[1:]), counts[names[0]])

    return counted


def _digits(text: str) -> Callable[[Measures], Column]:
    """Digits of all scripts; texts with characters far from Latin and Japanese are searched for them."""
    near, far = _kind("ascii_digit", "low_digit", text=text), _kind("far", text=text)
    return lambda m: F.when(far(m) == 0, near(m)).otherwise(T.count_class(m[text], T.DIGIT))


MEASURES: dict[str, Callable[[Measures], Column]] = {
    # Response, stripped, and its characters by kind. The middle dot counts as katakana and as
    # punctuation.
    "resp": lambda m: T.strip(m["response"]),
    "resp_length": lambda m: F.length(m["resp"]),
    "kata": _kind("kata", "dot"),
    "kanji": _kind("kanji"),
    "hira": _kind("hira"),
    "letters": _kind("letter"),
    "digits": _digits("resp"),
    "ascii_digits": _kind("ascii_digit"),
    "symbols": _kind("symbol"),
    "newlines": _kind("newline"),
    "ascii_spaces": _kind("blank"),
    "spaces": _kind("blank", "newline", "space"),
    "double_space": lambda m: m.scan("resp", "phrases", {"double_space": ["  "]})["double_space"] > 0,
    "monotonous": lambda m: m.scan("resp", "distinct", {"few": 3})["few"] < 3,
    "marks": _kind("mark", "dot"),
    "n_native": lambda m: m["kanji"] + m["hira"],
    "japanese_total": lambda m: m["kata"] + m["n_native"] + m["letters"] + m["digits"],
    "share": lambda m: T.ratio(m["kata"], m["japanese_total"]),
    "purity": lambda m: F.try_divide(m["kata"], m["resp_length"] - m["spaces"]),
    "packed_length": lambda m: m["resp_length"] - m["ascii_spaces"],
    "phrase_hits": lambda m: m.scan("resp", "phrases", {"unwanted": fixed.UNWANTED_PHRASES})["unwanted"],
    "explained": lambda m: m.scan("resp", "phrases", {"explained": fixed.EXPLANATIONS})["explained"] > 0,
    "chars_above_source": lambda m: m.scan("resp", "limits", {"above_source": "colon_length"})["above_source"],
    # Source as the rest of the instruction's line.
    "source": lambda m: tags.source_after_instruction(m["prompt"]),
    "source_length": lambda m: F.length(m["source"]),
    "source_digits": _digits("source"),
    "source_total": lambda m: _kind("kata", "dot", "kanji", "hira", "letter", text="source")(m) + m["source_digits"],
    "source_marks": _kind("mark", "dot", text="source"),
    "size": lambda m: T.ratio(m["resp_length"], m["source_length"]),
    "marks_kept": lambda m: F.try_divide(m["marks"], m["source_marks"]),
    # Source as the text after the last colon.
    "colon_source": lambda m: tags.source_after_colon(m["prompt"]),
    "colon_length": lambda m: F.length(m["colon_source"]),
    "colon_packed": lambda m: F.length(T.no_ascii_space(m["colon_source"])),
    "packed_share": lambda m: F.try_divide(m["packed_length"], m["colon_packed"]),
    # Tagged answers; the response is taken as it is.
    "strict_guess": lambda m: tags.solution_strict(m["response"]),
    "strict_share": lambda m: F.try_divide(T.parse_float(m["strict_guess"]), m["truth"]),
    "loose_guess": lambda m: tags.solution_loose(m["response"]),
    "loose_share": lambda m: F.try_divide(T.parse_float(m["loose_guess"]), m["truth"]),
    "number": lambda m: tags.solution_number(m["response"]),
    "number_value": lambda m: T.parse_float(m["number"]),
    "signed_number": lambda m: tags.solution_number(m["response"], signed=True),
    "signed_number_value": lambda m: T.parse_float(
        F.replace(m["signed_number"], F.lit(","), F.lit(""))
    ),
    "truth": lambda m: T.parse_float(m["answer"]),
}
