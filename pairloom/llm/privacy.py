"""Personal data in texts and the terms that give it away, with SQL functions only.

Addresses, cards and phone numbers are found by their patterns. Each distinct one is a
protected entity c. Words within CONTEXT characters of its mentions, up to the next match of the
same pattern, co-occur with it; over all documents a term t reveals the share

    PMI(c; t) / IC(c) = 1 - ln(n_t / n_ct) / ln(N / n_c)

of what there is to know about c: 1 if t is only met near c, 0 if t says nothing. A term whose
share for some entity reaches REMOVED is taken out wherever it stands, one that reaches
GENERALISED gives way to the kind of word it is. A term counts if it is met near the entity in
SUPPORT different texts at least, so a rare word of one text (or of its copies) reveals nothing.

Places count code points. A pattern's matches and the pieces between them come from the same
search, so places are running sums of lengths; no text is searched at every place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "general")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REMOVED]"}
CONTEXT, SUPPORT = 200, 3
REMOVED, GENERALISED = 0.98, 0.95
BROADCAST_TERMS = 100_000  # a table of more terms is joined by shuffle
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Possessive loops take what greedy ones take here and need no stack on long texts. A match starts
# where a run of its first class starts or the last match ended, so a long run is searched once.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_RUN = r"[\p{L}\p{N}]"
WORD = rf"(?<!{_RUN})(?={_RUN}{{3}})\p{{N}}*+\p{{L}}{_RUN}*+"  # three letters or digits and a letter among them


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """Running sums of an array of numbers, in pieces of the root of its length as arrays are copied to grow."""
    return _let(sizes, lambda a: _let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda step: _running(a, step)))


def _running(sizes: Column, step: Column) -> Column:
    def sums(a: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(a, empty, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all")))["all"]

    zero = F.lit(0).cast("bigint")
    pieces = F.transform(F.sequence(F.lit(1), F.size(sizes), step), lambda i: F.slice(sizes, i, step))
    totals = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x))
    starts = _let(totals, lambda t: F.zip_with(sums(t, zero), t, lambda end, own: end - own))
    out = F.flatten(F.zip_with(pieces, starts, sums))
    return F.when(F.size(sizes) > 0, out).otherwise(F.array().cast("array<bigint>"))


def _cut(text: Column, pattern: Column | str) -> Column:
    """(matches, pieces): a pattern's matches in a text, and the pieces before, between and after them."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))


def _zipped(cut: Column) -> Column:
    """Array of (value, stop, left, right): each match, where it ends and the pieces beside it."""
    return _let(cut, lambda c: _beside(c["matches"], c["pieces"]))


def _beside(matches: Column, pieces: Column) -> Column:
    n = F.size(matches)
    left = F.slice(pieces, F.lit(1), n)
    stops = running(F.zip_with(left, matches, lambda p, m: (F.length(p) + F.length(m)).cast("bigint")))
    return F.arrays_zip(
        matches.alias("value"), stops.alias("stop"), left.alias("left"), F.slice(pieces, F.lit(2), n).alias("right")
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.rlike(v, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": lambda v: _let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _entity(kind: str, value: Column) -> Column:
    own = fold(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind} "), own)


def without_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(fold(without_emails(text)), F.lit(WORD), F.lit(0)))


def _context(left: Column, right: Column) -> Column:
    """What stands within CONTEXT of a mention, without words cut at the far ends."""
    before = F.when(F.length(left) > CONTEXT, F.regexp_replace(F.right(left, F.lit(CONTEXT)), f"^{_RUN}+", "")).otherwise(left)
    after = F.when(F.length(right) > CONTEXT, F.regexp_replace(F.left(right, F.lit(CONTEXT)), f"{_RUN}+$", "")).otherwise(right)
    return F.concat(before, F.lit(" "), after)


def _mentions(text: Column, kind: str) -> Column:
    """Array of (start, stop, rank, kind, entity, context) of a kind's valid matches."""

    def row(m: Column) -> Column:
        return F.struct(
            (m["stop"] - F.length(m["value"])).alias("start"), m["stop"].alias("stop"), F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"), _entity(kind, m["value"]).alias("entity"), _context(m["left"], m["right"]).alias("context"),
        )

    may = F.contains(text, F.lit({"email": "@", "phone": "+", "ip": "."}.get(kind, "")))
    if kind != "email":
        may = may & F.rlike(text, F.lit("[0-9]"))
    found = F.filter(_zipped(_cut(text, PATTERNS[kind])), lambda m: VALID[kind](m["value"]))
    return F.when(may, F.transform(found, row))


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base, entities, pairs) of every row, in a written table: the MD5 of its text, its spans by
    pattern, the distinct entities and the distinct pairs of entity and term near it."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = F.concat(*(F.coalesce(F.col(k), F.array().cast(_MENTIONS)) for k in KINDS))
    rows = rows.select("id", F.md5("text").alias("h"), *(_mentions(F.col("text"), k).alias(k) for k in KINDS))
    rows = rows.select("id", "h", found.alias("found"))
    base = F.array_sort(F.transform("found", lambda m: F.struct(m["start"], m["rank"], m["stop"], m["kind"])))
    pairs = F.transform("found", lambda m: F.transform(terms(m["context"]), lambda t: F.concat(m["entity"], F.lit("\t"), t)))
    return written(rows.select(
        "id", "h", base.alias("base"), F.array_distinct(F.transform("found", lambda m: m["entity"])).alias("entities"),
        F.array_distinct(F.flatten(pairs)).alias("pairs"),
    ), "personal")


_MENTIONS = "array<struct<start:bigint,stop:bigint,rank:int,kind:string,entity:string,context:string>>"
_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT,
               removed: float = REMOVED, generalised: float = GENERALISED) -> DataFrame:
    """(term, entity, disclosure, kind): terms that reveal an entity, with the entity they reveal most of.

    All counts are of documents. The terms of all documents are counted in part where they are read.
    """
    near = found.select("h", F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("both"), F.count_distinct("h").alias("texts")
    ).where(F.col("texts") >= support).select(
        F.substring_index("pair", "\t", 1).alias("entity"), F.substring_index("pair", "\t", -1).alias("term"), "both"
    )
    near = written(near, "near_terms")
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = float(found.count())
    information = F.log(F.lit(n) / F.col("n_c"))
    share = 1 - F.log(F.greatest(F.col("n_t") / F.col("both"), F.lit(1.0))) / information
    rated = near.join(entities, "entity").where(F.col("n_c") < n).join(counts, "term").select(
        "term", F.struct(share.alias("disclosure"), F.col("entity").alias("entity")).alias("own")
    ).where(F.col("own.disclosure") >= generalised)
    kind = F.when(F.col("disclosure") >= removed, ADDED[0]).otherwise(ADDED[1])
    best = rated.groupBy("term").agg(F.max("own").alias("own")).select("term", "own.entity", "own.disclosure")
    return written(best.withColumn("kind", kind), "disclosing_terms")


def _blanked(text: Column) -> Column:
    """The text with blanks in place of its e-mail addresses."""
    def blank(p: Column, m: Column) -> Column:
        return F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit("")))

    blanks = _let(_cut(text, PATTERNS["email"]), lambda c: F.array_join(F.zip_with(c["pieces"], c["matches"], blank), ""))
    return F.when(F.contains(text, F.lit("@")), blanks).otherwise(text)


def term_spans(docs: DataFrame, revealing: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, added): the spans of disclosing terms, once for every text that has some."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    few = revealing.count() <= BROADCAST_TERMS
    held = rows.select(F.md5("text").alias("h"), F.explode(terms(F.col("text"))).alias("term"))
    held = held.join(F.broadcast(revealing) if few else revealing, "term").select("h", "term", "kind").distinct()
    held = held.groupBy("h").agg(
        F.collect_set("term").alias("all"), F.collect_set(F.when(F.col("kind") == ADDED[0], F.col("term"))).alias("gone")
    )
    held = written(held, "texts_with_terms")
    own = rows.withColumn("h", F.md5("text")).join(held, "h").dropDuplicates(["h"])
    pattern = F.concat(F.lit(f"(?<!{_RUN})(?i:"), F.array_join("all", "|"), F.lit(f")(?!{_RUN})"))
    own = own.select("h", "gone", _blanked(F.col("text")).alias("text"), pattern.alias("pattern"))
    first = len(KINDS)

    def span(m: Column) -> Column:
        gone = F.array_contains("gone", fold(m["value"]))
        return F.struct(
            (m["stop"] - F.length(m["value"])).alias("start"), F.when(gone, first).otherwise(first + 1).alias("rank"),
            m["stop"].alias("stop"), F.when(gone, ADDED[0]).otherwise(ADDED[1]).alias("kind"),
        )

    return own.select("h", F.transform(_zipped(_cut(F.col("text"), F.col("pattern"))), span).alias("added"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
          removed: float = REMOVED, generalised: float = GENERALISED) -> DataFrame:
    """(id, h, base, spans) of every row: spans by pattern, and these with those of disclosing terms.

    Spans are (start, rank, stop, kind) in code points, by start and kind. Null, empty and
    wordless texts have none. Repeated rows stay and count as documents of their own; ids may
    be null and may repeat. An empty table gives an empty result. Other columns are not read.
    """
    found = personal(docs, id_col, text_col)
    revealing = disclosing(docs, found, text_col, support, removed, generalised)
    added = term_spans(docs, revealing, text_col)
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return found.select("id", "h", "base").join(added, "h", "left").select("id", "h", "base", both.alias("spans"))


def spelt(found: Column) -> Column:
    """Spans as ``kind:start:stop`` with commas between."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = spans(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        F.col("id").alias(id_col), *map(count, KINDS), F.sha2(spelt(F.col("base")), 256).alias("base_sha256"),
        spelt(F.col("spans")).alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """The rows of ``docs`` with personal data and removed terms replaced by labels, generalised terms by the
    kind of word. Of spans that overlap the first counts. A null text stays null; otherwise as ``spans``."""
    by_text = spans(docs, id_col, text_col, **thresholds).where(F.size("spans") > 0).select("h", "spans").dropDuplicates(["h"])
    plan = docs.withColumn("_h", F.md5(F.col(text_col).cast("string"))).join(
        by_text.select(F.col("h").alias("_h"), F.col("spans").alias("_spans")), "_h", "left"
    )
    text = F.col(text_col)

    def label(s: Column) -> Column:
        word = F.substring(text, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int"))
        general = F.when(F.rlike(word, F.lit(r"\p{N}")), "[CODE]").when(F.rlike(word, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")
        for kind, own in LABELS.items():
            general = F.when(s["kind"] == kind, own).otherwise(general)
        return general

    def step(acc: Column, s: Column) -> Column:
        plain = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["stop"].alias("at"), F.concat(acc["parts"], F.array(plain, label(s))).alias("parts")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return plan.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(clean)).select(*docs.columns)
