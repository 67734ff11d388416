"""Readers for pair files, text lines and named data sets, and the build-once table."""

from __future__ import annotations

import re
import uuid
import warnings
from collections import Counter
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.operators import sample
from pairloom.session import path_exists

FILE_ORDER = ["file_ord", "file", "split_pos", "line_key"]
LINE = ["file", "line_no", "copy"]  # a line's place, whatever the splits and the other files
BUILDING = "_BUILDING"  # marker of a folder that ``cached`` has begun to write
_RECORD = "array<struct<output:variant,input:variant>>"


class MissingInput(UserWarning):
    """Some of the given paths name no file."""


def parse_pairs(lines: DataFrame, column: str = "value", keep_bad: bool = False) -> DataFrame:
    """``kanji_text`` and ``katakana_text`` out of JSON lines, one record per line.

    A line counts if it is one JSON object whose ``output`` and ``input`` are strings.
    Variant fields keep the JSON type, so numbers are not taken for text. The record is
    parsed inside brackets: anything after the object then spoils the parse. ``inline``
    keeps the parse in one place, where a plain projection would be repeated by every
    filter pushed below it. With ``keep_bad`` other lines stay, with NULL texts.
    """
    wrapped = F.concat(F.lit("["), strip(F.col(column)), F.lit("]"))
    records = F.from_json(wrapped, _RECORD, {"allowSingleQuotes": "false"})
    one = F.when(F.size("_records") == 1, F.col("_records"))
    rest = [c for c in lines.columns if c != column]
    raw = lines.select(*rest, records.alias("_records")).select(
        *rest, (F.inline_outer if keep_bad else F.inline)(one)
    )
    is_pair = (
        (F.schema_of_variant("output") == "STRING") & (F.schema_of_variant("input") == "STRING")
    )
    if not keep_bad:
        raw = raw.where(is_pair)

    def text(name):
        value = F.try_variant_get(F.col(name), "$", "string")
        return F.when(is_pair, value) if keep_bad else value

    return raw.select(
        *rest, text("output").alias("kanji_text"), text("input").alias("katakana_text")
    )


def _roots(spark: SparkSession, path: str) -> list[str]:
    """Files and folders that a path or glob names, as the scan spells them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(found.getPath().toString()) for found in system.globStatus(target) or ()]


def _plain_path(uri: str) -> str:
    return re.sub("^file:/+", "/", unquote(uri)).rstrip("/")


def scan_files(
    spark: SparkSession, paths: Sequence[str], line_numbers: bool = False
) -> tuple[DataFrame | None, list[str]]:
    """Lines of the given files, folders and globs, and the paths that name nothing.

    One scan reads them all; a table with a row per file gives each its path's number. In
    ``FILE_ORDER`` lines stand path by path, in a path file by file by name, and in a file
    as they are. A file that two paths name has its lines under both. ``line_numbers`` adds
    the columns of ``LINE``: a line's number in its file and the number of earlier paths that
    name the file; they are the same however the files are split and whatever else is read.
    """
    roots = {i: _roots(spark, p) for i, p in enumerate(paths)}
    missing = [p for i, p in enumerate(paths) if not roots[i]]
    distinct = sorted({r for found in roots.values() for r in found})
    if not distinct:
        return None, missing
    folders = {_plain_path(r) for r in distinct}
    outer = [r for r in distinct if not any(str(up) in folders for up in PurePosixPath(_plain_path(r)).parents)]
    lines = spark.read.text(outer)
    numbers: dict[str, list[int]] = {}
    for i, found in roots.items():
        for r in found:
            numbers.setdefault(_plain_path(r), []).append(i)
    files = []
    for uri in lines.inputFiles():
        own = PurePosixPath(_plain_path(uri))
        as_scanned = re.sub("^file:/+", "file:/", uri)  # the scan's own spelling of local files
        files += [(as_scanned, i) for up in (own, *own.parents) for i in numbers.get(str(up), ())]
    scanned = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_pos"),
        F.monotonically_increasing_id().alias("line_key"), "value",
    )
    names, ordinals = zip(*dict.fromkeys(files), strict=True)
    seen: Counter[str] = Counter()
    copies = [seen.update([name]) or seen[name] - 1 for name in names]  # ordinals of one file ascend
    # an Arrow table keeps its size known, so the planner broadcasts it while it is small
    named = spark.createDataFrame(pa.table({
        "file": names, "file_ord": pa.array(ordinals, pa.int32()), "copy": pa.array(copies, pa.int32()),
    }))
    if line_numbers:
        scanned = _numbered(scanned)
    found = ["file_ord", "file", "split_pos", "line_key", *(["line_no", "copy"] if line_numbers else [])]
    return scanned.join(named, "file").select(*found, "value"), missing


def _numbered(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, the line's 0-based place in its file.

    Lines are counted by split, which reads the files once more; sums over a file's splits give
    the number of each split's first line. A split lies in one task, in order, and both reads
    are made in the same splits, as they are parts of one query. Only counts are shuffled; the
    table of splits is broadcast, as the planner can't know it is small before lines are sent.
    """
    split = ["file", "split_pos"]
    before = W.partitionBy("file").orderBy("split_pos").rowsBetween(W.unboundedPreceding, -1)
    starts = lines.groupBy(*split).agg(F.count("*").alias("_n"), F.min("line_key").alias("_first")).select(
        *split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return lines.join(F.broadcast(starts), split).withColumn("line_no", F.col("_start") + F.col("line_key") - F.col("_first"))


def read_pairs_jsonl(
    spark: SparkSession, paths: Sequence[str], rate: float = 1.0, seed=0, line_numbers: bool = False
) -> DataFrame:
    """Pairs of all existing files, with their place in the files.

    Paths that name nothing are reported in a ``MissingInput`` warning; if there is no file
    at all, that is an error. ``rate`` samples the lines before they are parsed, each line by
    its file and number, so equal lines are drawn one by one and the sample stays the same when
    files are split otherwise or others are added. ``line_numbers`` keeps these columns.
    """
    lines, missing = scan_files(spark, paths, line_numbers or rate < 1.0)
    if lines is None:
        raise FileNotFoundError(f"no input file exists: {missing}")
    if missing:
        warnings.warn(f"skipped, as nothing is there: {missing}", MissingInput, stacklevel=2)
    if rate < 1.0:
        lines = sample.bernoulli(lines, rate, seed, LINE)
    return parse_pairs(lines if line_numbers else lines.drop("line_no", "copy"))


def read_text_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """Stripped lines of a text file, blank ones left out."""
    stripped = spark.read.text(path).select(strip(F.col("value")).alias(column))
    return stripped.where(F.length(column) > 0)


def read_dataset(
    spark: SparkSession, root: str, name: str, split: str, config: str = "default"
) -> DataFrame:
    """One split of a named data set kept as ``root/name/config`` partitioned by split."""
    table = spark.read.option("basePath", f"{root}/{name}/{config}")
    return table.parquet(f"{root}/{name}/{config}").where(F.col("split") == split)


def write_dataset(
    df: DataFrame, root: str, name: str, config: str = "default", split: str = "split"
) -> None:
    """Write a named data set with a ``split`` column in the layout read above."""
    df.withColumnRenamed(split, "split").write.partitionBy("split").parquet(
        f"{root}/{name}/{config}"
    )


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Table at ``path``, built on first use.

    The table is built beside the path and moved there when it is complete, so a reader
    never sees half of it. Of two jobs that start together one's table is taken; a folder
    that is there already is read, never replaced.
    """
    if not path_exists(spark, path):
        building = f"{path}{BUILDING}-{uuid.uuid4().hex}"
        write_table(build(), building)
        jvm = spark.sparkContext._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (building, path))
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # a move onto a folder that another job put there meanwhile would land inside it
        if path_exists(spark, path) or not system.rename(source, target):
            system.delete(source, True)
    return spark.read.parquet(path)


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 0,
    partition_by: Sequence[str] = (),
) -> None:
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
