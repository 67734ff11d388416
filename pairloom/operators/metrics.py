"""Throughput, conversion quality and array checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T


def throughput(df: DataFrame, text: str = "text", seconds: str = "seconds") -> DataFrame:
    """Total and mean seconds and characters per second; NULL speed without time."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("mean_seconds"),
        F.try_divide(F.sum(F.length(text)), F.sum(seconds)).alias("chars_per_second"),
    )


def compare_speed(
    df: DataFrame, base: str, other: str, mode: str = "mode", text: str = "text",
    seconds: str = "seconds",
) -> DataFrame:
    """Characters per second of two modes and the gain of the second over the first."""

    def speed(name: str) -> Column:
        chosen = F.col(mode) == name
        return F.try_divide(
            F.sum(F.when(chosen, F.length(text))), F.sum(F.when(chosen, F.col(seconds)))
        )

    return df.agg(speed(base).alias("base_speed"), speed(other).alias("other_speed")).select(
        "base_speed", "other_speed", F.try_divide("other_speed", "base_speed").alias("gain")
    )


def share_batch_time(
    df: DataFrame, batch: str = "batch_id", batch_seconds: str = "batch_seconds"
) -> DataFrame:
    """Split each batch's time evenly over its rows.

    Counted with map-side partial sums and joined back, so a hot batch id is never sorted
    in one task as it would be under a window. Rows without batch id are one batch.
    """
    sizes = df.groupBy(batch).agg(F.count("*").alias("batch_size"))
    sizes = sizes.withColumnRenamed(batch, "_batch")
    return df.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch").withColumn(
        "seconds", F.col(batch_seconds) / F.col("batch_size")
    )


def row_quality(df: DataFrame, text: str = "text", output: str = "output") -> DataFrame:
    """Ratios and left-over script counts per converted row."""
    out = F.col(output)
    return df.withColumns({
        "katakana_ratio": T.inline_ratio(out),
        "purity": F.coalesce(T.purity_nonspace(out), F.lit(0.0)),
        "length_ratio": T.length_ratio(out, F.col(text)),
        "hiragana_left": T.count_class(out, T.HIRAGANA),
        "kanji_left": T.count_class(out, T.KANJI),
    })


def quality_summary(df: DataFrame, *by: str) -> DataFrame:
    """Quality of a run; failed rows only count as failures."""
    ok = F.col("error").isNull()
    return row_quality(df).groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~ok).alias("n_failed"),
        F.avg(F.when(ok, F.col("katakana_ratio"))).alias("mean_katakana_ratio"),
        F.avg(F.when(ok, F.col("purity"))).alias("mean_purity"),
        F.avg(F.when(ok, F.col("length_ratio"))).alias("mean_length_ratio"),
        F.count_if(ok & (F.col("hiragana_left") > 0)).alias("n_with_hiragana"),
        F.count_if(ok & (F.col("kanji_left") > 0)).alias("n_with_kanji"),
        F.count_if(ok & (F.col("purity") >= 0.95)).alias("n_purity_met"),
        F.count_if(ok & F.col("length_ratio").between(0.8, 2.0)).alias("n_length_met"),
    )


def zero_fraction(df: DataFrame, key: str, values: str) -> DataFrame:
    """Share of zeros in the arrays of each key, and whether they are nothing but zeros."""
    zeros = F.size(F.filter(values, lambda x: x == 0))
    sums = df.groupBy(key).agg(
        F.sum(zeros).alias("n_zeros"), F.sum(F.size(values)).alias("n_values")
    )
    return sums.select(
        key, "n_zeros", "n_values",
        F.try_divide("n_zeros", "n_values").alias("zero_fraction"),
        (F.col("n_zeros") == F.col("n_values")).alias("all_zero"),
    )


def require_nonzero(df: DataFrame, key: str, values: str) -> DataFrame:
    """As ``zero_fraction``, but the job fails if some key holds only zeros."""
    found = zero_fraction(df, key, values)
    key_text = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    message = F.concat(F.lit("all values are zero for "), key_text)
    # a filter, as a projection nobody reads would be pruned and the check with it
    return found.where(
        F.when(F.col("all_zero"), F.raise_error(message).cast("boolean")).otherwise(True)
    )
