"""DuckDB fragments shared by the check statements."""

from __future__ import annotations

from pairloom.functions import fixed
from pairloom.functions import text as T
from pairloom.plans import inputs as I


def q(value: str) -> str:
    """SQL string literal."""
    parts = value.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in T.SPACE_CHARS) + ")"


# Written out here, apart from the patterns under test.
_BLANK = (
    "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
    "\\x{205f}\\x{3000}]*"
)
PATTERNS = {
    "strict": f"(?sm)^{_BLANK}<start_working_out>.+?<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>{_BLANK}$",
    "loose": f"(?sm)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>{_BLANK}(?:<\\|endoftext\\|>)?{_BLANK}$",
    "number": "(?sm)<SOLUTION>.*?([\\p{Nd}.]+)",
    "signed_number": f"(?sm)<SOLUTION>.*?{_BLANK}(-?[\\p{{Nd}}.,]+)",
}


def strip(x):
    return f"trim({x}, {SPACES})"


def count(x, char_class):
    return f"(length({x}) - length(regexp_replace({x}, '[{char_class}]+', '', 'g')))"


def nonspace(x):
    return f"length(regexp_replace({x}, '[{T.FLAT_SPACE}]+', '', 'g'))"


def packed(x):
    return f"replace({x}, ' ', '')"


def phrase(x, p):
    return f"((length({x}) - length(replace({x}, {q(p)}, ''))) // {len(p)})"


def ratio(a, b):
    return f"(({a})::DOUBLE / greatest({b}, 1))"


def divide(a, b):
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def total(x):
    """Kana, kanji, ASCII letters and digits, class by class."""
    return "(" + " + ".join(
        count(x, c) for c in (T.KATAKANA, T.HIRAGANA, T.KANJI, T.ASCII_LETTER, T.FLAT_DIGIT)
    ) + ")"


def plain_number(x):
    """Number of ASCII digits."""
    return _number(f"lower({strip(x)})", "[0-9]+")


def number(x):
    """Number as Python reads it: also full-width digits and groups with underscores."""
    s = f"translate(lower({strip(x)}), '０１２３４５６７８９', '0123456789')"
    return _number(s, "[0-9](_?[0-9])*")


def _number(s, digits):
    return (
        f"(CASE WHEN regexp_full_match({s}, '[+-]?({digits}\\.?({digits})?|\\.{digits})(e[+-]?{digits})?') "
        f"THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) "
        f"WHEN regexp_full_match({s}, '\\+?(inf|infinity)') THEN 'inf'::DOUBLE "
        f"WHEN regexp_full_match({s}, '-(inf|infinity)') THEN '-inf'::DOUBLE "
        f"WHEN regexp_full_match({s}, '[+-]?nan') THEN 'nan'::DOUBLE END)"
    )


def group(x, regex):
    return (
        f"(CASE WHEN regexp_matches({x}, {q(regex)}) THEN regexp_extract({x}, {q(regex)}, 1) END)"
    )


def digest(seed, *keys):
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def below(hashed, rate):
    return f"(('0x' || left({hashed}, 8))::BIGINT < {int(rate * 2**32)})"


def steps(*pairs, default):
    whens = " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v in pairs)
    return f"(CASE {whens} ELSE {default}::DOUBLE END)"


def source_after_colon(x):
    return strip(
        f"CASE WHEN contains({x}, '：') THEN split_part({x}, '：', -1) "
        f"ELSE split_part({x}, ':', -1) END"
    )


def gemma(*turns):
    """Rendered text of (role, SQL content) turns without a system turn."""
    names = {"assistant": "model"}
    body = [
        f"{q(fixed.TURN_START + names.get(r, r))} || chr(10) || {c} || {q(fixed.TURN_END)} || chr(10)"
        for r, c in turns
    ]
    return f"({q(fixed.BOS)} || " + " || ".join(body) + ")"


def pair_text():
    return gemma(
        ("user", f"{q(fixed.INSTRUCTION)} || kanji_text"), ("assistant", "katakana_text")
    )


PAIRS = f"""
doc_lines AS (
  SELECT doc_id, lang, unnest(string_split(lower(text), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no
  FROM documents),
pairs AS (
  SELECT doc_id, line_no::INTEGER AS line_no, lang,
         translate(line, '{I.LATIN}', '{I.KANJI}') AS kanji_text,
         translate(line, '{I.LATIN}', '{I.KATA}') AS katakana_text
  FROM doc_lines)"""

GAPPED = """
  SELECT * FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)
    AND (conv_id % 4 <> 1 OR role = 'system' OR turn = 0)"""

EXCHANGES = """
exchanges AS (
  SELECT a.conv_id, a.turn, a.text AS question, b.text AS reply
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

PROMPTS = PAIRS + """,
prompts AS (
  SELECT doc_id, line_no, translate(kanji_text, '.,', '。、') AS source,
         translate(katakana_text, '.,', '。、') AS target
  FROM pairs)"""

ROLLOUTS = PROMPTS + f""",
rollouts AS (
  SELECT doc_id, line_no, {q(fixed.INSTRUCTION)} || source AS prompt, gen_id::INTEGER AS gen_id,
         CASE gen_id WHEN 0 THEN target WHEN 1 THEN source WHEN 2 THEN target || 'です'
           WHEN 3 THEN '' WHEN 4 THEN target || target || target WHEN 5 THEN left(target, 2)
           WHEN 6 THEN '変換結果は' || target
           ELSE repeat('ア', length(source) + 1) || 'ABC12' END AS response
  FROM prompts, range(8) AS g(gen_id)),
stripped AS (
  SELECT doc_id, line_no, gen_id, prompt, {strip('response')} AS resp,
         {source_after_colon('prompt')} AS colon_source
  FROM rollouts)"""

_SAID = """CASE o_orderkey % 8
  WHEN 1 THEN '  ' || o_orderkey || ' '
  WHEN 2 THEN (o_orderkey * 105 // 100) || '.' || lpad((o_orderkey * 105 % 100)::VARCHAR, 2, '0')
  WHEN 3 THEN (o_orderkey * 115 // 100) || '.' || lpad((o_orderkey * 115 % 100)::VARCHAR, 2, '0')
  WHEN 4 THEN (o_orderkey * 2)::VARCHAR
  WHEN 5 THEN 'about ' || o_orderkey
  WHEN 7 THEN (o_orderkey // 1000) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')
  ELSE o_orderkey::VARCHAR END"""

NUMBERS = f"""
numbers AS (
  SELECT o_orderkey AS prompt_id, 'Order ' || o_orderkey AS prompt,
    CASE WHEN o_orderkey % 8 = 6 THEN o_orderkey::VARCHAR ELSE
      CASE WHEN o_custkey % 2 = 0 THEN {q(fixed.WORK_START)} ELSE '' END
      || {q("Let me think!" + chr(10) + fixed.WORK_END + fixed.SOLUTION_START)}
      || CASE o_custkey % 7 WHEN 3 THEN translate({_SAID}, '0123456789', '０１２３４５６７８９')
           WHEN 5 THEN replace({_SAID}, ',', '_') ELSE {_SAID} END
      || {q(fixed.SOLUTION_END)}
      || CASE WHEN o_custkey % 3 = 0 THEN chr(10) ELSE '' END
      || CASE WHEN o_custkey % 5 = 0 THEN {q(fixed.EOS)} ELSE '' END END AS response,
    CASE WHEN o_orderkey % 64 = 10 THEN '0' WHEN o_orderkey % 64 = 17 THEN NULL
      ELSE o_orderkey::VARCHAR END AS answer
  FROM orders)"""

CONVERSIONS = f"""
flat AS (
  SELECT conv_id, turn, (conv_id * 31 + turn) % 50 AS part,
         lower(replace(text, chr(10), ' ')) AS line
  FROM conversations),
conversions AS (
  SELECT conv_id, turn, translate(line, '{I.LATIN}', '{I.KANJI}') AS text,
         CASE WHEN part = 0 THEN {q(fixed.ERROR_PREFIX + "failed")}
              WHEN part % 3 = 1 THEN translate(line, '{I.LATIN}', '{I.KANJI}')
              ELSE translate(line, '{I.LATIN}', '{I.KATA}') END AS output,
         CASE WHEN part = 0 THEN 0::DOUBLE
              ELSE 0.1::DOUBLE + 0.05::DOUBLE * (conv_id % 7) END AS seconds,
         CASE WHEN part = 0 THEN 'failed' END AS error
  FROM flat)"""
