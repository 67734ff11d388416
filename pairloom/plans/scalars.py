"""Script counts, ratios and text extraction, over all lines, turns or orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import fixed, tags
from pairloom.functions import text as T
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.registry import query

# Both scripts, Latin leftovers, digits and punctuation in one text.
MIXED = "kanji_text || ' ' || katakana_text || ' ' || lang || doc_id"
MIXED_CTE = f"{D.PAIRS}, mixed AS (SELECT doc_id, line_no, {MIXED} AS s FROM pairs)"
SCRIPTS = {
    "katakana": T.KATAKANA, "hiragana": T.HIRAGANA, "kanji": T.KANJI,
    "english": T.ASCII_LETTER, "numbers": T.FLAT_DIGIT,
}
COUNTS = ", ".join(f"{D.count('s', c)} AS {n}" for n, c in SCRIPTS.items())


def _mixed(spark, sf):
    text = F.concat("kanji_text", F.lit(" "), "katakana_text", F.lit(" "), "lang",
                    F.col("doc_id").cast("string"))
    return I.pairs(spark, sf).select(*I.PAIR_KEY, text.alias("s"))


def _profile(spark, sf, variant):
    profiled = _mixed(spark, sf).withColumn("p", T.script_profile(F.col("s"), variant))
    return profiled.select(*I.PAIR_KEY, "p.*").withColumn(
        "katakana_ratio", F.round("katakana_ratio", 6)
    )


@query("script_counts", f"WITH {MIXED_CTE} SELECT doc_id, line_no, {COUNTS} FROM mixed")
def script_counts(spark, sf):
    counted = _mixed(spark, sf).withColumn("c", T.script_counts(F.col("s")))
    return counted.select(*I.PAIR_KEY, "c.*")


@query("script_profile", f"""
WITH {MIXED_CTE}, counted AS (SELECT doc_id, line_no, s, {COUNTS} FROM mixed)
SELECT doc_id, line_no, katakana, hiragana, kanji, english, numbers,
       katakana + hiragana + kanji + english + numbers AS japanese_total,
       round({D.ratio('katakana', 'katakana + hiragana + kanji + english + numbers')}, 6)
         AS katakana_ratio, length(s) AS total_length FROM counted""")
def script_profile(spark, sf):
    return _profile(spark, sf, "default")


@query("script_profile_fast", f"""
WITH {MIXED_CTE}, counted AS (
  SELECT doc_id, line_no, s, {COUNTS}, {D.count('s', T.ALNUM)} AS alnum FROM mixed)
SELECT doc_id, line_no, katakana, hiragana, kanji,
       katakana + hiragana + kanji + alnum AS japanese_total,
       round({D.ratio('katakana', 'katakana + hiragana + kanji + alnum')}, 6) AS katakana_ratio,
       length(s) AS total_length FROM counted""")
def script_profile_fast(spark, sf):
    return _profile(spark, sf, "fast")


INLINE = D.count("s", T.HIRAGANA + T.KATAKANA + T.KANJI + T.ALNUM)


@query("script_ratio_inline", f"""
WITH {MIXED_CTE}
SELECT doc_id, line_no, {INLINE} AS n_counted,
       round({D.ratio(D.count('s', T.KATAKANA), INLINE)}, 6) AS ratio FROM mixed""")
def script_ratio_inline(spark, sf):
    s = F.col("s")
    return _mixed(spark, sf).select(
        *I.PAIR_KEY, T.inline_total(s).alias("n_counted"),
        F.round(T.inline_ratio(s), 6).alias("ratio"),
    )


@query("purity_nonspace", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no,
       round({D.divide(D.count('katakana_text', T.KATAKANA), D.nonspace('katakana_text'))}, 6)
         AS purity,
       round({D.ratio(D.count('katakana_text', T.KATAKANA), 'length(' + D.packed('katakana_text') + ')')}, 6)
         AS purity_length
FROM pairs""")
def purity_nonspace(spark, sf):
    target = F.col("katakana_text")
    return I.pairs(spark, sf).select(
        *I.PAIR_KEY, F.round(T.purity_nonspace(target), 6).alias("purity"),
        F.round(T.purity_length(target), 6).alias("purity_length"),
    )


ASKED = f"""
asked AS (
  SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN 'Convert: ' || kanji_text
    ELSE {D.q(fixed.INSTRUCTION)} || translate(kanji_text, ',', '：') || chr(10) || lang END AS prompt
  FROM pairs)"""
AFTER = fixed.INSTRUCTION + "([^\\n]+)"


@query("prompt_source", f"""
WITH {D.PAIRS}, {ASKED}
SELECT doc_id, line_no, {D.strip(D.group('prompt', AFTER))} AS after_instruction,
       {D.source_after_colon('prompt')} AS after_colon FROM asked""")
def prompt_source(spark, sf):
    source = F.col("kanji_text")
    prompt = F.when(
        F.col("line_no") % 7 == 0, F.concat(F.lit("Convert: "), source)
    ).otherwise(F.concat(
        F.lit(fixed.INSTRUCTION), F.translate(source, ",", "："), F.lit("\n"), F.col("lang")
    ))
    return I.pairs(spark, sf).select(
        *I.PAIR_KEY, tags.source_after_instruction(prompt).alias("after_instruction"),
        tags.source_after_colon(prompt).alias("after_colon"),
    )


def _solution(kind):
    return (
        f"WITH {D.NUMBERS} SELECT prompt_id, "
        f"{D.group('response', D.PATTERNS[kind])} AS solution FROM numbers"
    )


@query("solution_strict", _solution("strict"))
def solution_strict(spark, sf):
    found = tags.solution_strict(F.col("response"))
    return I.number_rollouts(spark, sf).select("prompt_id", found.alias("solution"))


@query("solution_loose", _solution("loose"))
def solution_loose(spark, sf):
    found = tags.solution_loose(F.col("response"))
    return I.number_rollouts(spark, sf).select("prompt_id", found.alias("solution"))


@query("solution_number", f"""
WITH {D.NUMBERS}
SELECT prompt_id, {D.group('response', D.PATTERNS['number'])} AS number,
       {D.group('response', D.PATTERNS['signed_number'])} AS signed_number
FROM numbers""")
def solution_number(spark, sf):
    response = F.col("response")
    return I.number_rollouts(spark, sf).select(
        "prompt_id", tags.solution_number(response).alias("number"),
        tags.solution_number(response, signed=True).alias("signed_number"),
    )


@query("strip_prompt", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, {D.strip('katakana_text')} AS output FROM pairs""")
def strip_prompt(spark, sf):
    prompt = F.concat(F.lit(fixed.INSTRUCTION), F.col("kanji_text"))
    generated = F.concat(
        F.lit("> "), prompt, F.lit("\n"), prompt, F.lit(" \n"), "katakana_text", F.lit("　")
    )
    return I.pairs(spark, sf).select(
        *I.PAIR_KEY, tags.strip_prompt(generated, prompt).alias("output")
    )


@query("phrase_counts", f"""
WITH {D.ROLLOUTS}
SELECT doc_id, line_no, gen_id, {D.phrase('response', 'です')} AS n_desu,
       {D.phrase('response', '変換結果')} AS n_result,
       {' + '.join(D.phrase('response', p) for p in fixed.UNWANTED_PHRASES)} AS n_unwanted
FROM rollouts""")
def phrase_counts(spark, sf):
    response = F.col("response")
    return I.rollouts(spark, sf).select(
        *I.ROLLOUT_KEY, T.count_phrase(response, "です").alias("n_desu"),
        T.count_phrase(response, "変換結果").alias("n_result"),
        T.count_phrases(response, fixed.UNWANTED_PHRASES).alias("n_unwanted"),
    )
