"""Sources, sinks and streams, run on files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import chat
from pairloom.operators import curate, order, sample
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.curation import COLUMNAR, SFT
from pairloom.plans.registry import query
from pairloom.session import fresh_path
from pairloom.sources import pairs as P
from pairloom.sources import report as R
from pairloom.streaming import curate as S

# Kinds of record lines that hold a valid pair.
GOOD = "(doc_id + line_no) % 11 IN (5, 6, 9, 10)"
# Place of each language's folder in the list of paths; the second path does not exist.
CAP_FILES = "CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"
LANG_FILES = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"


@query("jsonl_parse", f"WITH {D.PAIRS} SELECT kanji_text, katakana_text FROM pairs WHERE {GOOD}")
def jsonl_parse(spark, sf):
    read = P.read_pairs_jsonl(spark, [I.record_files(spark, sf)])
    return read.select("kanji_text", "katakana_text")


@query("multi_file_scan", f"""
WITH {D.PAIRS}
SELECT {LANG_FILES} AS file_ord, kanji_text AS value FROM pairs""")
def multi_file_scan(spark, sf):
    root = fresh_path(spark, "by_lang")
    lines = I.pairs(spark, sf).select("lang", "kanji_text")
    lines.write.partitionBy("lang").text(root)
    names = ["en", "none", "fr", "de", "es"]
    scanned, missing = P.scan_files(spark, [f"{root}/lang={n}" for n in names])
    assert [m.endswith("none") for m in missing] == [True]
    return scanned.select("file_ord", "value")


@query("cap_across_files", f"""
WITH {D.PAIRS}, placed AS (
  SELECT {CAP_FILES} AS file_ord, kanji_text, row_number() OVER (ORDER BY {CAP_FILES}, doc_id, line_no) - 1
    AS row_idx FROM pairs WHERE {GOOD} AND {SFT})
SELECT row_idx, file_ord, kanji_text FROM placed WHERE row_idx < 400""")
def cap_across_files(spark, sf):
    """The cap ends inside a later path; a path is a folder of several files."""
    root = fresh_path(spark, "by_lang")
    parts = I.n_parts(spark, sf, 4)
    lines = I.lines(spark, sf).repartitionByRange(parts, *I.PAIR_KEY).sortWithinPartitions("lang", *I.PAIR_KEY)
    I.as_records(lines).select("lang", "value").write.partitionBy("lang").text(root)
    read = P.read_pairs_jsonl(spark, [f"{root}/lang={n}" for n in ["es", "fr", "d*", "en"]])
    capped = order.first_n(curate.keep(read, curate.sft_rules()), 400, P.FILE_ORDER)
    return capped.select("row_idx", "file_ord", "kanji_text")


@query("sample_before_parse", f"""
WITH {D.PAIRS}, lines AS (
  SELECT lang, kanji_text, katakana_text, {GOOD} AS good,
         doc_id % 8 AS part,
         row_number() OVER (PARTITION BY lang, doc_id % 8 ORDER BY doc_id, line_no) - 1 AS line_no FROM pairs)
SELECT lang, part, line_no, kanji_text, katakana_text FROM lines
WHERE good AND {D.below(D.digest(7, 'lang', 'part', 'line_no'), 0.25)}""")
def sample_before_parse(spark, sf):
    """Lines of files of a language's part each, sampled by file and line number, then parsed."""
    root = fresh_path(spark, "by_part")
    file = ["lang", "part"]
    lines = I.lines(spark, sf).withColumn("part", F.col("doc_id") % 8)
    lines = lines.repartition(*file).sortWithinPartitions(*file, *I.PAIR_KEY)
    I.as_records(lines).select(*file, "value").write.partitionBy(*file).text(root)
    scanned, _ = P.scan_files(spark, [root], line_numbers=True)
    place = F.col("file")
    scanned = scanned.select(
        F.regexp_extract(place, "/lang=([^/]+)/", 1).alias("lang"),
        F.regexp_extract(place, "/part=([0-9]+)/", 1).cast("bigint").alias("part"), "line_no", "value",
    )
    drawn = sample.bernoulli(scanned, 0.25, 7, [*file, "line_no"])
    return P.parse_pairs(drawn).select(*file, "line_no", "kanji_text", "katakana_text")


@query("dataset_split_scan", f"""
SELECT doc_id, text, 'train' AS split FROM documents
WHERE NOT {D.below("md5('3407:' || doc_id)", 0.25)}""")
def dataset_split_scan(spark, sf):
    root = fresh_path(spark, "datasets")
    labelled = sample.train_test(
        I.documents(spark, sf).select("doc_id", "text"), 0.25, 3407, ["doc_id"]
    )
    P.write_dataset(labelled, root, "prose", "main")
    return P.read_dataset(spark, root, "prose", "train", "main").select("doc_id", "text", "split")


@query("cached_pairs", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, {D.pair_text()} AS text FROM pairs WHERE {COLUMNAR}""")
def cached_pairs(spark, sf):
    path = fresh_path(spark, "cache")

    def build():
        text = chat.render_pair(F.col("kanji_text"), F.col("katakana_text"))
        kept = curate.keep(I.pairs(spark, sf), curate.sft_columnar_rules())
        return kept.select(*I.PAIR_KEY, text.alias("text"))

    P.cached(spark, path, build)
    return P.cached(spark, path, build)


@query("text_lines", f"""
WITH {D.PAIRS}
SELECT {D.strip('kanji_text')} AS text FROM pairs WHERE {D.strip('kanji_text')} <> ''""")
def text_lines(spark, sf):
    path = fresh_path(spark, "lines")
    padded = F.concat(F.lit("　 "), "kanji_text", F.lit("\t　"))
    I.pairs(spark, sf).select(padded.alias("value")).write.text(path)
    return P.read_text_lines(spark, path)


@query("report_lines", f"""
WITH {D.CONVERSIONS}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq FROM conversions),
totals AS (
  SELECT sum(seconds) AS s, avg(seconds) AS m, sum(length(text)) AS chars FROM conversions),
lines AS (
  SELECT -1 AS seq, 0 AS sub, printf('📊 総処理時間: %.3f秒', s) AS line FROM totals
  UNION ALL SELECT -1, 1, printf('⚡ 平均処理時間: %.3f秒/文', m) FROM totals
  UNION ALL SELECT -1, 2, printf('🚀 平均処理速度: %.1f 文字/秒', chars / s) FROM totals
  UNION ALL SELECT -1, 3, repeat('=', 60)
  UNION ALL SELECT -1, 4, ''
  UNION ALL SELECT seq, 0, '入力: ' || text FROM numbered
  UNION ALL SELECT seq, 1, '出力: ' || output FROM numbered
  UNION ALL SELECT seq, 2, printf('推論時間: %.3f秒', seconds) FROM numbered WHERE seconds > 0
  UNION ALL SELECT seq, 3, printf('処理速度: %.1f 文字/秒', length(text) / seconds)
    FROM numbered WHERE seconds > 0
  UNION ALL SELECT seq, 4, repeat('-', 40) FROM numbered)
SELECT seq::BIGINT AS seq, sub, line FROM lines""")
def report_lines(spark, sf):
    numbered = order.with_row_index(I.conversions(spark, sf), I.TURN_KEY, "seq")
    return R.report_lines(numbered)


@query("stream_curate", f"""
WITH {D.PAIRS}
SELECT kanji_text, katakana_text, {D.pair_text()} AS text FROM pairs WHERE {GOOD} AND {SFT}""")
def stream_curate(spark, sf):
    lines = S.read_lines(spark, I.record_files(spark, sf, 4), files_per_trigger=2)
    out = fresh_path(spark, "curated")
    S.start_curation(lines, f"{out}/table", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("stream_counts", f"""
WITH {D.PAIRS}, judged AS (
  SELECT CASE WHEN NOT {GOOD} THEN 'bad_record'
              WHEN NOT (length(kanji_text) <= 100 AND length(katakana_text) <= 100) THEN 'too_long'
              WHEN NOT ({SFT}) THEN 'blank' ELSE 'kept' END AS reason FROM pairs)
SELECT reason, count(*) AS n_rows FROM judged GROUP BY reason""")
def stream_counts(spark, sf):
    lines = S.read_lines(spark, I.record_files(spark, sf, 4), files_per_trigger=2)
    out = fresh_path(spark, "counts")
    S.start_counts(lines, f"{out}/table", f"{out}/progress").awaitTermination()
    return S.latest_counts(spark, f"{out}/table")
