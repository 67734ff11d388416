"""Inputs of the registered queries, derived by Spark from the driver's tables.

The tables hold no Japanese text; ``translate`` turns Latin letters into kana and kanji,
the same way in Spark and in the check statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import chat, fixed
from pairloom.session import fresh_path

LATIN = "abcdefghijklmnopqrstuvwxyz"
KATA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
KANJI = "天い国え音会き空本語さ新す世そ大地月ての東なに山ね海"
FULL_WIDTH = "０１２３４５６７８９"
PAIR_KEY = ["doc_id", "line_no"]
TURN_KEY = ["conv_id", "turn"]
ROLLOUT_KEY = [*PAIR_KEY, "gen_id"]
PART_BYTES = 64 << 20  # text of documents that one task orders or one file holds, about


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of documents, lower-cased."""
    split = documents(spark, sf).select(
        "doc_id", "lang", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line")
    )
    return split.select("doc_id", (F.col("pos") + 1).alias("line_no"), "lang", "line")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One (source, target) pair per line of a document."""
    return as_pairs(lines(spark, sf))


def as_pairs(lines: DataFrame) -> DataFrame:
    """The pairs of lines; other columns stay as they are, and so does the order."""
    return lines.select(
        *(c for c in lines.columns if c != "line"),
        F.translate("line", LATIN, KANJI).alias("kanji_text"),
        F.translate("line", LATIN, KATA).alias("katakana_text"),
    )


def n_parts(spark: SparkSession, sf: str, least: int = 1) -> int:
    """Tasks or files for the documents' lines of about PART_BYTES each, at least so many."""
    size = documents(spark, sf).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // PART_BYTES))


def as_records(lines: DataFrame) -> DataFrame:
    """JSON line per line of a document; by ``kind`` some are broken, of wrong type or padded.

    Records are some six times as long as lines, so lines are what is put in order or dealt.
    """
    p = as_pairs(lines).withColumn("kind", F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(11)))
    whole = F.to_json(F.struct(
        F.col("kanji_text").alias("output"), F.col("katakana_text").alias("input"),
        F.col("lang").alias("left_context"),
    ))
    only_input = F.to_json(F.struct(F.col("katakana_text").alias("input")))

    def with_output(value):
        return F.concat(F.lit('{"output":'), value, F.lit(","), F.expr("substr(only_input, 2)"))

    p = p.withColumns({"whole": whole, "only_input": only_input})
    kind = F.col("kind")
    line = (
        F.when(kind == 0, F.expr("substr(whole, 1, length(whole) - 1)"))
        .when(kind == 1, F.col("only_input"))
        .when(kind == 2, with_output(F.lit("null")))
        .when(kind == 3, with_output(F.col("doc_id").cast("string")))
        .when(kind == 4, with_output(F.lit('["a"]')))
        .when(kind == 5, F.concat(F.lit('{"output":"first",'), F.expr("substr(whole, 2)")))
        .when(kind == 6, F.concat(F.lit("  "), "whole", F.lit(" \t")))
        .when(kind == 7, F.concat("whole", F.lit(" x")))
        .when(kind == 8, F.lit(""))
        .otherwise(F.col("whole"))
    )
    return p.select(*(c for c in lines.columns if c != "line"), "kind", line.alias("value"))


def record_files(spark: SparkSession, sf: str, n_files: int | None = None) -> str:
    """Folder of JSONL files with the lines above, at least so many; more where they would be large."""
    path = fresh_path(spark, "records")
    own = lines(spark, sf)
    if n_files:
        own = own.repartition(n_parts(spark, sf, n_files))
    as_records(own).select("value").write.text(path)
    return path


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def gapped_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of which some conversations lack the one after the first, some all but the system's."""
    conv, turn = F.col("conv_id"), F.col("turn")
    gap = (conv % 3 == 0) & (turn == 1)
    return turns(spark, sf).where(~gap & ((conv % 4 != 1) | (F.col("role") == "system") | (turn == 0)))


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """User turn with the assistant turn after it.

    Joined on conversation and turn number together, so a hot conversation is spread.
    """
    t = turns(spark, sf)
    asked = t.where(F.col("role") == "user").select(*TURN_KEY, F.col("text").alias("question"))
    replied = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replied, TURN_KEY)


def rollout_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt messages and expected target per pair, with Japanese punctuation."""
    return lines(spark, sf).select(
        *PAIR_KEY, F.translate("line", LATIN + ".,", KANJI + "。、").alias("source"),
        F.translate("line", LATIN + ".,", KATA + "。、").alias("target"),
    )


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Eight graded responses per pair, made inside the row."""
    source, target = F.col("source"), F.col("target")
    responses = F.array(
        target,
        source,
        F.concat(target, F.lit("です")),
        F.lit(""),
        F.repeat(target, F.lit(3)),
        F.substring(target, 1, 2),
        F.concat(F.lit("変換結果は"), target),
        F.concat(F.repeat(F.lit("ア"), F.length(source) + 1), F.lit("ABC12")),
    )
    return rollout_prompts(spark, sf).select(
        *PAIR_KEY, chat.instruction(source).alias("prompt"),
        F.posexplode(responses).alias("gen_id", "response"),
    )


def number_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged answers to orders: exact, padded, off by a factor, worded, untagged, also in wide digits."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def decimal(hundredths):
        return F.concat(
            F.floor(hundredths / 100).cast("string"), F.lit("."),
            F.lpad((hundredths % 100).cast("string"), 2, "0"),
        )

    variant = key % 8
    text = key.cast("string")
    said = (
        F.when(variant == 1, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(variant == 2, decimal(key * 105))
        .when(variant == 3, decimal(key * 115))
        .when(variant == 4, (key * 2).cast("string"))
        .when(variant == 5, F.concat(F.lit("about "), text))
        .when(variant == 7, F.concat(
            F.floor(key / 1000).cast("string"), F.lit(","),
            F.lpad((key % 1000).cast("string"), 3, "0"),
        ))
        .otherwise(text)
    )
    said = F.when(cust % 7 == 3, F.translate(said, "0123456789", FULL_WIDTH)).when(
        cust % 7 == 5, F.translate(said, ",", "_")
    ).otherwise(said)
    tagged = F.concat(
        F.when(cust % 2 == 0, fixed.WORK_START).otherwise(""),
        F.lit("Let me think!\n" + fixed.WORK_END + fixed.SOLUTION_START), said,
        F.lit(fixed.SOLUTION_END),
        F.when(cust % 3 == 0, "\n").otherwise(""),
        F.when(cust % 5 == 0, fixed.EOS).otherwise(""),
    )
    answer = F.when(key % 64 == 10, "0").when(key % 64 == 17, None).otherwise(text)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompt_id"),
        F.concat(F.lit("Order "), text).alias("prompt"),
        F.when(variant == 6, text).otherwise(tagged).alias("response"),
        answer.alias("answer"),
    )


def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a conversion run over all turns: some converted, some not, some failed."""
    one_line = F.lower(F.translate("text", "\n", " "))
    text = F.translate(one_line, LATIN, KANJI)
    output = F.translate(one_line, LATIN, KATA)
    part = (F.col("conv_id") * 31 + F.col("turn")) % 50
    failed = part == 0
    return turns(spark, sf).select(
        *TURN_KEY,
        text.alias("text"),
        F.when(failed, fixed.ERROR_PREFIX + "failed")
        .when(part % 3 == 1, text).otherwise(output).alias("output"),
        F.when(failed, 0.0).otherwise(0.1 + 0.05 * (F.col("conv_id") % 7)).alias("seconds"),
        F.when(failed, "failed").alias("error"),
    )


def hiragana_to_katakana():
    """Stand-in converter for checks: shifts hiragana to katakana."""
    shift = {p: p + 0x60 for p in range(0x3041, 0x3097)}
    return lambda texts: [t.translate(shift) for t in texts]


def tolerant_converter():
    """Stand-in converter that takes anything."""
    return lambda texts: [f"None?{t}" for t in texts]


def picky_converter():
    """Stand-in converter that refuses texts with a question mark or without letters."""
    convert = hiragana_to_katakana()

    def each(texts):
        for t in texts:
            if "?" in t or not t.strip():
                raise ValueError("refused")
        return convert(texts)

    return each
