"""Filters, budgets and drop reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import chat, fixed
from pairloom.functions import text as T
from pairloom.operators import curate, sample
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.registry import query

PAIR_COLUMNS = [*I.PAIR_KEY, "kanji_text", "katakana_text"]


def _within(low, high):
    return " AND ".join(
        f"length({c}) BETWEEN {low} AND {high}" for c in ("kanji_text", "katakana_text")
    )


FILLED = " AND ".join(f"{D.strip(c)} <> ''" for c in ("kanji_text", "katakana_text"))
SFT = f"{_within(0, 100)} AND {FILLED}"
KATA = D.count("katakana_text", T.KATAKANA)
COLUMNAR = (
    f"{_within(3, 80)} AND {D.ratio(KATA, 'length(' + D.packed('katakana_text') + ')')} >= 0.7"
)
PROFILE = f"{_within(5, 60)} AND {D.ratio(KATA, D.total('katakana_text'))} >= 0.8"
STRICT = (
    f"{_within(3, 40)} AND {FILLED} "
    "AND len(list_distinct(string_split(kanji_text, ''))) >= 3 "
    f"AND coalesce({D.divide(KATA, D.nonspace('katakana_text'))} >= 0.8, true)"
)


def _select(where, columns="doc_id, line_no, kanji_text, katakana_text"):
    return f"WITH {D.PAIRS} SELECT {columns} FROM pairs WHERE {where}"


@query("filter_sft", _select(SFT))
def filter_sft(spark, sf):
    return curate.keep(I.pairs(spark, sf), curate.sft_rules()).select(*PAIR_COLUMNS)


@query("filter_seq2seq", _select(f"{_within(0, 80)} AND {FILLED}"))
def filter_seq2seq(spark, sf):
    return curate.keep(I.pairs(spark, sf), curate.seq2seq_rules()).select(*PAIR_COLUMNS)


@query("filter_sft_columnar", _select(COLUMNAR))
def filter_sft_columnar(spark, sf):
    return curate.keep(I.pairs(spark, sf), curate.sft_columnar_rules()).select(*PAIR_COLUMNS)


@query("filter_grpo_profile", _select(
    PROFILE,
    "doc_id, line_no, kanji_text, katakana_text, "
    f"round({D.ratio(KATA, D.total('katakana_text'))}, 6) AS ratio",
))
def filter_grpo_profile(spark, sf):
    kept = curate.keep(I.pairs(spark, sf), curate.profile_rules())
    return kept.select(
        *PAIR_COLUMNS, F.round(T.profile_ratio(F.col("katakana_text")), 6).alias("ratio")
    )


@query("filter_grpo_strict", _select(STRICT))
def filter_grpo_strict(spark, sf):
    return curate.keep(I.pairs(spark, sf), curate.strict_rules()).select(*PAIR_COLUMNS)


WORDS = (
    f"CASE WHEN {D.strip('chat_text')} = '' THEN 0 ELSE "
    f"len(string_split_regex({D.strip('chat_text')}, '[{T.FLAT_SPACE}]+')) END"
)


@query("filter_token_budget", f"""
WITH {D.PAIRS}, chats AS (
  SELECT doc_id, line_no, kanji_text, katakana_text, {D.pair_text()} AS chat_text
  FROM pairs WHERE {SFT})
SELECT doc_id, line_no, length(chat_text) AS n_chars, {WORDS} AS n_words
FROM chats WHERE length(chat_text) <= 192 AND {WORDS} <= 24""")
def filter_token_budget(spark, sf):
    text = chat.render_pair(F.col("kanji_text"), F.col("katakana_text"))
    rules = [
        *curate.sft_rules(), curate.pair_budget_rule(192),
        curate.pair_budget_rule(24, "words"),
    ]
    return curate.keep(I.pairs(spark, sf), rules).select(
        *I.PAIR_KEY, T.token_len(text).alias("n_chars"),
        T.token_len(text, "words").alias("n_words"),
    )


def split_encoder():
    """Stand-in tokenizer: one token per word."""
    return str.split


@query("filter_python_tokens", f"""
WITH {D.PAIRS}, sized AS (
  SELECT doc_id, line_no, len(list_filter(string_split(kanji_text, ' '), lambda w: w <> '')) AS n_tokens FROM pairs)
SELECT doc_id, line_no, n_tokens::INTEGER AS n_tokens FROM sized WHERE n_tokens <= 12""")
def filter_python_tokens(spark, sf):
    size = T.python_token_len(split_encoder)
    plain = F.translate("kanji_text", "\t\r\x0b\x0c", "____")
    sized = I.pairs(spark, sf).select(*I.PAIR_KEY, T.token_len(plain, size).alias("n_tokens"))
    return sized.where("n_tokens <= 12")


NUMBER_TEXTS = """
answers AS (
  SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || 'e3'
    WHEN 2 THEN 'nan' WHEN 3 THEN '-inf' WHEN 4 THEN p_size || 'd' WHEN 5 THEN p_type
    WHEN 6 THEN NULL WHEN 7 THEN '1_' || p_size WHEN 8 THEN '.' || p_size
    ELSE p_size::VARCHAR END AS expected_answer
  FROM part)"""


@query("filter_numeric_answer", f"""
WITH {NUMBER_TEXTS}, parsed AS (
  SELECT *, {D.plain_number('expected_answer')} AS x FROM answers)
SELECT p_partkey, expected_answer FROM parsed WHERE x IS NOT NULL AND NOT isnan(x)""")
def filter_numeric_answer(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 10
    answer = (
        F.when(kind == 0, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(kind == 1, F.concat(size, F.lit("e3")))
        .when(kind == 2, "nan").when(kind == 3, "-inf")
        .when(kind == 4, F.concat(size, F.lit("d"))).when(kind == 5, F.col("p_type"))
        .when(kind == 6, None).when(kind == 7, F.concat(F.lit("1_"), size))
        .when(kind == 8, F.concat(F.lit("."), size)).otherwise(size)
    )
    answers = I.table(spark, sf, "part").select("p_partkey", answer.alias("expected_answer"))
    return curate.keep(answers, [curate.numeric_rule("expected_answer")])


@query("filter_p90_length", f"""
WITH sized AS (
  SELECT conv_id, turn, length({D.q(fixed.SYSTEM_PROMPT)} || text) AS n_tokens
  FROM conversations)
SELECT conv_id, turn, n_tokens FROM sized
WHERE n_tokens <= (SELECT trunc(quantile_cont(n_tokens, 0.9))::BIGINT FROM sized)""")
def filter_p90_length(spark, sf):
    tokens = T.token_len(F.concat(F.lit(fixed.SYSTEM_PROMPT), F.col("text")))
    sized = I.turns(spark, sf).select(*I.TURN_KEY, tokens.alias("n_tokens"))
    return curate.keep_quantile(sized, F.col("n_tokens"), 0.9)


@query("curation_report", f"""
WITH {D.PAIRS}, judged AS (
  SELECT CASE WHEN NOT {D.below(D.digest(7, 'doc_id', 'line_no'), 0.25)} THEN 'not_sampled'
              WHEN NOT ({_within(0, 100)}) THEN 'too_long'
              WHEN NOT ({FILLED}) THEN 'blank'
              WHEN length({D.pair_text()}) > 192 THEN 'over_budget' ELSE 'kept' END AS reason
  FROM pairs)
SELECT reason, count(*) AS n_rows FROM judged GROUP BY reason""")
def curation_report(spark, sf):
    sampled = T.below_rate(T.digest(7, *map(F.col, I.PAIR_KEY)), 0.25)
    rules = [("not_sampled", sampled), *curate.sft_rules(), curate.pair_budget_rule(192)]
    return curate.report(I.pairs(spark, sf), rules)
