"""Samples, caps, positions, shuffles and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import chat
from pairloom.operators import curate, mix, order, sample
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.curation import SFT
from pairloom.plans.registry import query

def _digest(seed):
    return D.digest(seed, "doc_id", "line_no")


@query("sample_bernoulli", f"""
WITH {D.PAIRS} SELECT doc_id, line_no, kanji_text FROM pairs
WHERE {D.below(_digest(7), 0.25)}""")
def sample_bernoulli(spark, sf):
    drawn = sample.bernoulli(I.pairs(spark, sf), 0.25, 7, I.PAIR_KEY)
    return drawn.select(*I.PAIR_KEY, "kanji_text")


@query("cap_first_n", f"""
WITH {D.PAIRS}, kept AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_idx
  FROM pairs WHERE {SFT})
SELECT row_idx, doc_id, line_no, kanji_text FROM kept WHERE row_idx < 1000""")
def cap_first_n(spark, sf):
    kept = curate.keep(I.pairs(spark, sf), curate.sft_rules())
    return order.first_n(kept, 1000, I.PAIR_KEY).select("row_idx", *I.PAIR_KEY, "kanji_text")


@query("cap_large_prefix", f"""
WITH {D.PAIRS}, keyed AS (
  SELECT doc_id, line_no, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lead FROM pairs)
SELECT row_number() OVER (ORDER BY lead NULLS FIRST, doc_id, line_no) - 1 AS row_idx, doc_id, line_no, lead
FROM keyed QUALIFY row_idx < 12000""")
def cap_large_prefix(spark, sf):
    """A prefix beyond what one task takes; a third of the rows share the null leading key."""
    lead = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lead")
    keyed = I.pairs(spark, sf).select(*I.PAIR_KEY, lead)
    return order.first_n(keyed, 12_000, ["lead", *I.PAIR_KEY]).select("row_idx", *I.PAIR_KEY, "lead")


@query("cap_null_keys", """
WITH keyed AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 3 <> 0 THEN role END AS lead FROM conversations)
SELECT row_number() OVER (ORDER BY lead NULLS FIRST, conv_id, turn) - 1 AS row_idx, conv_id, turn, lead
FROM keyed QUALIFY row_idx < (SELECT count(*) FROM keyed WHERE lead IS NULL) + 20""")
def cap_null_keys(spark, sf):
    """A text as leading key, null for a third of the rows; the cap ends beyond the nulls."""
    lead = F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("lead")
    keyed = I.turns(spark, sf).select(*I.TURN_KEY, lead)
    n = keyed.where("lead IS NULL").count() + 20
    indexed = order.with_row_index(keyed, ["lead", *I.TURN_KEY])  # n grows with the table
    return indexed.where(F.col("row_idx") < n).select("row_idx", *I.TURN_KEY, "lead")


@query("sample_exact", f"""
WITH {D.PAIRS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY {_digest(2407)}) AS rn FROM pairs)
SELECT doc_id, line_no, kanji_text FROM ranked WHERE rn <= 1500""")
def sample_exact(spark, sf):
    drawn = sample.exact(I.pairs(spark, sf), 1500, 2407, I.PAIR_KEY)
    return drawn.select(*I.PAIR_KEY, "kanji_text")


@query("shuffle_seeded", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, katakana_text,
       row_number() OVER (ORDER BY {_digest(3407)}, doc_id, line_no) - 1 AS shuffle_pos
FROM pairs""")
def shuffle_seeded(spark, sf):
    shuffled = sample.shuffle(I.pairs(spark, sf), 3407, I.PAIR_KEY)
    return shuffled.select(*I.PAIR_KEY, "katakana_text", "shuffle_pos")


@query("train_test_split", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no,
       CASE WHEN {D.below(_digest(3407), 0.01)} THEN 'test' ELSE 'train' END AS split
FROM pairs""")
def train_test_split(spark, sf):
    labelled = sample.train_test(I.pairs(spark, sf), 0.01, 3407, I.PAIR_KEY)
    return labelled.select(*I.PAIR_KEY, "split")


@query("batch_assign", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_idx,
       (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 8 AS batch_id
FROM pairs""")
def batch_assign(spark, sf):
    keys = I.pairs(spark, sf).select(*I.PAIR_KEY)
    return order.with_batch_id(keys, 8, I.PAIR_KEY)


@query("row_lookup", f"""
WITH {D.PAIRS}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_idx FROM pairs)
SELECT row_idx, doc_id, line_no, kanji_text, katakana_text FROM numbered
WHERE row_idx IN (0, 100)""")
def row_lookup(spark, sf):
    found = order.lookup(I.pairs(spark, sf), [0, 100], I.PAIR_KEY)
    return found.select("row_idx", *I.PAIR_KEY, "kanji_text", "katakana_text")


@query("preview", f"""
WITH {D.PAIRS}, rendered AS (
  SELECT doc_id, line_no, {D.pair_text()} AS text FROM pairs ORDER BY doc_id, line_no LIMIT 3)
SELECT doc_id, line_no,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text
FROM rendered""")
def preview(spark, sf):
    text = chat.render_pair(F.col("kanji_text"), F.col("katakana_text"))
    rendered = I.pairs(spark, sf).select(*I.PAIR_KEY, text.alias("text"))
    return order.preview(rendered, "text", 3, 200, I.PAIR_KEY)


def _sets(spark, sf):
    """Documents labelled good as reasoning set, all others as chat set."""
    labels = I.table(spark, sf, "labels").select("doc_id", "quality")
    docs = I.documents(spark, sf).select("doc_id", "text").join(labels, "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return (
        docs.where(good).select("doc_id", F.lit("reasoning").alias("origin"), "text"),
        docs.where(~good).select("doc_id", F.lit("chat").alias("origin"), "text"),
    )


SETS = """
docs AS (
  SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'reasoning' ELSE 'chat' END AS origin
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
sizes AS (
  SELECT count(*) FILTER (origin = 'reasoning') AS n_reasoning,
         count(*) FILTER (origin = 'chat') AS n_chat FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY md5('2407:' || doc_id)) AS rn
  FROM docs)"""


def _mixed(condition):
    return f"""
WITH {SETS}, mixed AS (SELECT r.* FROM ranked r, sizes s WHERE {condition})
SELECT doc_id, origin, text,
       row_number() OVER (ORDER BY md5('3407:' || doc_id), doc_id) - 1 AS shuffle_pos
FROM mixed"""


@query("mixture", _mixed(
    "origin = 'reasoning' OR rn <= trunc(s.n_reasoning * (1.0::DOUBLE - 0.75::DOUBLE))"
))
def mixture(spark, sf):
    return mix.mixture(*_sets(spark, sf), 0.75, ["doc_id"])


@query("mixture_share", _mixed(
    "rn <= CASE origin WHEN 'reasoning' THEN least(s.n_reasoning, floor(s.n_chat / 3.0::DOUBLE)) "
    "ELSE least(s.n_chat, floor(s.n_reasoning * 3.0::DOUBLE)) END"
))
def mixture_share(spark, sf):
    return mix.mixture(*_sets(spark, sf), 0.75, ["doc_id"], mode="share")
