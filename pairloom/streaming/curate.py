"""Curation of JSONL files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions import chat
from pairloom.operators import curate
from pairloom.sources.pairs import parse_pairs


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def curated(lines: DataFrame, rules=None) -> DataFrame:
    """Training text of the pairs that pass; the same code serves batch and stream."""
    rules = curate.sft_rules() if rules is None else rules
    kept = curate.keep(parse_pairs(lines), rules)
    text = chat.render_pair(F.col(curate.SOURCE), F.col(curate.TARGET))
    return kept.select(curate.SOURCE, curate.TARGET, text.alias("text"))


def start_curation(lines: DataFrame, out: str, checkpoint: str, rules=None) -> StreamingQuery:
    """Append curated text to a table until the files at hand are done."""
    return (
        curated(lines, rules).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drop_counts(lines: DataFrame, rules=None) -> DataFrame:
    """Running counts per drop reason; the state holds one row per reason."""
    rules = curate.sft_rules() if rules is None else rules
    parsed = parse_pairs(lines, keep_bad=True)
    is_pair = ("bad_record", F.col(curate.SOURCE).isNotNull())
    return curate.report(parsed, [is_pair, *rules])


def start_counts(lines: DataFrame, out: str, checkpoint: str, rules=None) -> StreamingQuery:
    """Write the totals after every batch; a repeated batch overwrites its own totals."""

    def totals(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        drop_counts(lines, rules).writeStream.outputMode("complete").foreachBatch(totals)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    table = spark.read.parquet(out)
    newest = table.agg(F.max("batch").alias("newest")).scalar()
    return table.where(F.col("batch") == newest).drop("batch")
