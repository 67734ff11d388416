"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.session import fresh_path

BATCH_ROWS = 1_000  # texts in a batch
PART_ROWS, PART_TEXTS = 20_000, 4_000  # rows of numbers, or with a text, that are worth a file


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session hand at most ``rows`` rows at a time to Python workers; fewer stay fewer.

    Texts are large rows: the default of 10,000 is held by the JVM, by Arrow and by pandas at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, kept if executors go."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """The rows of ``df`` in no more partitions than ``rows`` rows need, ``each`` in one; fewer stay fewer.

    A task that writes a file starts a process to set its mode, which shares the executor's
    memory until it runs. So a small table does not get a file for every shuffle partition.
    """
    return df.coalesce(max(1, -(-rows // each)))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at blank and the controls 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
