"""Conversion report as ordered text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators.metrics import throughput


def report_lines(results: DataFrame, seq: str = "seq") -> DataFrame:
    """Report of a run as ``(seq, sub, line)``; the header has ``seq`` -1.

    ``results`` holds ``text``, ``output`` and ``seconds``; rows without time, such as
    failed ones, have no time and speed lines.
    """
    header = throughput(results).select(
        F.lit(-1).cast("bigint").alias("seq"),
        F.posexplode(F.array(
            F.format_string(fixed.REPORT_TOTAL, "total_seconds"),
            F.format_string(fixed.REPORT_MEAN, "mean_seconds"),
            F.format_string(fixed.REPORT_SPEED, "chars_per_second"),
            F.lit("=" * 60), F.lit(""),
        )).alias("sub", "line"),
    )
    speed = F.try_divide(F.length("text"), F.col("seconds"))
    timed = F.col("seconds") > 0
    body = results.select(
        F.col(seq).cast("bigint").alias("seq"),
        F.posexplode(F.array(
            F.concat(F.lit(fixed.REPORT_INPUT), "text"),
            F.concat(F.lit(fixed.REPORT_OUTPUT), "output"),
            F.when(timed, F.format_string(fixed.REPORT_ROW_TIME, "seconds")),
            F.when(timed, F.format_string(fixed.REPORT_ROW_SPEED, speed)),
            F.lit("-" * 40),
        )).alias("sub", "line"),
    ).where(F.col("line").isNotNull())
    return header.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """Write the lines in order; large reports become several files in name order."""
    lines.orderBy("seq", "sub").select("line").write.text(path)
