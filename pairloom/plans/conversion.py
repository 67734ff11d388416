"""Batch conversion, throughput and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.functions import text as T
from pairloom.operators import convert, metrics, order
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.registry import query

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
SHIFTED = f"translate(kanji_text, '{HIRAGANA}', '{''.join(chr(ord(c) + 0x60) for c in HIRAGANA)}')"


@query("batch_convert_stub", f"""
WITH {D.PAIRS} SELECT doc_id, line_no, {SHIFTED} AS output, true AS timed FROM pairs""")
def batch_convert_stub(spark, sf):
    texts = I.pairs(spark, sf).select(*I.PAIR_KEY, "kanji_text")
    done = convert.batch_convert(texts, "kanji_text", I.hiragana_to_katakana)
    return done.select(*I.PAIR_KEY, "output", (F.col("seconds") >= 0).alias("timed"))


def join_lists(batch):
    """Foreign code of the batched map: joins the two texts of each row."""
    joined = [f"{a}\t{b}" for a, b in zip(batch["kanji_text"], batch["katakana_text"])]
    return {"doc_id": batch["doc_id"], "line_no": batch["line_no"], "text": joined}


@query("batched_map", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, kanji_text || chr(9) || katakana_text AS text FROM pairs""")
def batched_map(spark, sf):
    schema = "doc_id bigint, line_no int, text string"
    return convert.map_batches(I.pairs(spark, sf), join_lists, schema)


REFUSED = f"(contains(kanji_text, '?') OR {D.strip('kanji_text')} = '')"


@query("convert_errors", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, CASE WHEN {REFUSED} THEN '{fixed.ERROR_PREFIX}refused' ELSE {SHIFTED} END
  AS output, CASE WHEN {REFUSED} THEN 'refused' END AS error FROM pairs""")
def convert_errors(spark, sf):
    texts = I.pairs(spark, sf).select(*I.PAIR_KEY, "kanji_text")
    done = convert.batch_convert(texts, "kanji_text", I.picky_converter)
    return done.select(*I.PAIR_KEY, "output", "error")


@query("convert_nulls", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no,
       CASE WHEN line_no % 4 = 1 THEN '{fixed.ERROR_PREFIX}no text' ELSE 'None?' || kanji_text END AS output,
       CASE WHEN line_no % 4 = 1 THEN 'no text' END AS error FROM pairs""")
def convert_nulls(spark, sf):
    """A converter that would take anything never sees a NULL text."""
    text = F.when(F.col("line_no") % 4 != 1, F.col("kanji_text")).alias("kanji_text")
    texts = I.pairs(spark, sf).select(*I.PAIR_KEY, text)
    done = convert.batch_convert(texts, "kanji_text", I.tolerant_converter)
    return done.select(*I.PAIR_KEY, "output", "error")


@query("throughput_summary", f"""
WITH {D.CONVERSIONS}
SELECT count(*) AS n_rows, round(sum(seconds), 6) AS total_seconds,
       round(avg(seconds), 6) AS mean_seconds,
       round({D.divide('sum(length(text))', 'sum(seconds)')}, 6) AS chars_per_second
FROM conversions""")
def throughput_summary(spark, sf):
    summary = metrics.throughput(I.conversions(spark, sf))
    return summary.select("n_rows", *[
        F.round(c, 6).alias(c) for c in ("total_seconds", "mean_seconds", "chars_per_second")
    ])


@query("speed_comparison", f"""
WITH {D.CONVERSIONS}, speeds AS (
  SELECT {D.divide('sum(length(text))', 'sum(seconds)')} AS base_speed,
         {D.divide('sum(length(text))', 'sum(0.05::DOUBLE)')} AS other_speed FROM conversions)
SELECT round(base_speed, 6) AS base_speed, round(other_speed, 6) AS other_speed,
       round(other_speed / base_speed, 6) AS gain FROM speeds""")
def speed_comparison(spark, sf):
    runs = I.conversions(spark, sf).select("text", F.explode(F.array(
        F.struct(F.lit("single").alias("mode"), F.col("seconds")),
        F.struct(F.lit("batched").alias("mode"), F.lit(0.05).alias("seconds")),
    )).alias("run")).select("text", "run.*")
    speeds = metrics.compare_speed(runs, "single", "batched")
    return speeds.select(*[F.round(c, 6).alias(c) for c in speeds.columns])


@query("batch_time_share", """
WITH numbered AS (
  SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id
  FROM conversations)
SELECT conv_id, turn, batch_id, count(*) OVER (PARTITION BY batch_id) AS batch_size,
       round((0.4::DOUBLE + 0.1::DOUBLE * (batch_id % 5))
             / count(*) OVER (PARTITION BY batch_id), 6) AS seconds FROM numbered""")
def batch_time_share(spark, sf):
    keys = I.turns(spark, sf).select(*I.TURN_KEY)
    batches = order.with_batch_id(keys, 8, I.TURN_KEY).withColumn(
        "batch_seconds", 0.4 + 0.1 * (F.col("batch_id") % 5)
    )
    shared = metrics.share_batch_time(batches)
    return shared.select(
        *I.TURN_KEY, "batch_id", "batch_size", F.round("seconds", 6).alias("seconds")
    )


@query("batch_time_null_ids", """
WITH batches AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 0 THEN conv_id // 4 END AS batch_id FROM conversations)
SELECT conv_id, turn, batch_id, count(*) OVER (PARTITION BY batch_id) AS batch_size,
       round(12::DOUBLE / count(*) OVER (PARTITION BY batch_id), 6) AS seconds FROM batches""")
def batch_time_null_ids(spark, sf):
    conv = F.col("conv_id")
    batches = I.turns(spark, sf).select(
        *I.TURN_KEY, F.when(conv % 4 != 0, F.floor(conv / 4)).alias("batch_id"), F.lit(12.0).alias("batch_seconds")
    )
    shared = metrics.share_batch_time(batches)
    return shared.select(*I.TURN_KEY, "batch_id", "batch_size", F.round("seconds", 6).alias("seconds"))


INLINE = D.count("output", T.HIRAGANA + T.KATAKANA + T.KANJI + T.ALNUM)
QUALITY = f"""
quality AS (
  SELECT conv_id, turn, error, {D.ratio(D.count('output', T.KATAKANA), INLINE)} AS katakana_ratio,
         coalesce({D.divide(D.count('output', T.KATAKANA), D.nonspace('output'))}, 0) AS purity,
         coalesce({D.divide('length(output)', 'length(text)')}, 0) AS length_ratio,
         {D.count('output', T.HIRAGANA)} AS hiragana_left,
         {D.count('output', T.KANJI)} AS kanji_left FROM conversions)"""


@query("conversion_rows", f"""
WITH {D.CONVERSIONS}, {QUALITY}
SELECT conv_id, turn, round(katakana_ratio, 6) AS katakana_ratio, round(purity, 6) AS purity,
       round(length_ratio, 6) AS length_ratio, hiragana_left, kanji_left FROM quality
WHERE error IS NULL""")
def conversion_rows(spark, sf):
    judged = metrics.row_quality(convert.succeeded(I.conversions(spark, sf)))
    rounded = [
        F.round(c, 6).alias(c) for c in ("katakana_ratio", "purity", "length_ratio")
    ]
    return judged.select(*I.TURN_KEY, *rounded, "hiragana_left", "kanji_left")


@query("conversion_quality", f"""
WITH {D.CONVERSIONS}, {QUALITY}
SELECT count(*) AS n_rows, count(error) AS n_failed,
       round(avg(katakana_ratio) FILTER (error IS NULL), 6) AS mean_katakana_ratio,
       round(avg(purity) FILTER (error IS NULL), 6) AS mean_purity,
       round(avg(length_ratio) FILTER (error IS NULL), 6) AS mean_length_ratio,
       count(*) FILTER (error IS NULL AND hiragana_left > 0) AS n_with_hiragana,
       count(*) FILTER (error IS NULL AND kanji_left > 0) AS n_with_kanji,
       count(*) FILTER (error IS NULL AND purity >= 0.95) AS n_purity_met,
       count(*) FILTER (error IS NULL AND length_ratio BETWEEN 0.8 AND 2.0) AS n_length_met
FROM quality""")
def conversion_quality(spark, sf):
    summary = metrics.quality_summary(I.conversions(spark, sf))
    return summary.select(*[
        F.round(c, 6).alias(c) if c.startswith("mean_") else F.col(c) for c in summary.columns
    ])


ZEROED = """
WITH cut AS (
  SELECT label, list_transform(embedding, lambda x: CASE WHEN x < 0 OR label = 3 THEN 0 ELSE x END) AS v
  FROM embeddings),
counted AS (
  SELECT label, sum(len(list_filter(v, lambda x: x = 0)))::BIGINT AS n_zeros, sum(len(v))::BIGINT AS n_values
  FROM cut GROUP BY label)
SELECT label, n_zeros, n_values, n_zeros::DOUBLE / n_values AS zero_fraction, n_zeros = n_values AS all_zero
FROM counted"""


def _zeroed(spark, sf):
    """Embeddings without their negative parts; those of label 3 are nothing but zeros."""
    keep = F.transform("embedding", lambda x: F.when((x < 0) | (F.col("label") == 3), 0.0).otherwise(x))
    return I.table(spark, sf, "embeddings").select("label", keep.alias("embedding"))


@query("zero_fraction", ZEROED)
def zero_fraction(spark, sf):
    return metrics.zero_fraction(_zeroed(spark, sf), "label", "embedding")


@query("require_nonzero", f"SELECT label, zero_fraction FROM ({ZEROED}) WHERE label <> 3")
def require_nonzero(spark, sf):
    some = _zeroed(spark, sf).where("label <> 3")
    return metrics.require_nonzero(some, "label", "embedding").select("label", "zero_fraction")
