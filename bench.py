"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. A copy of ``documents`` in several
files is made first, as one row group is read by one task; making it is reported apart. Every
query runs ``BENCH_RUNS`` times to the end, through the no-op sink: all rows and columns are
computed and none are collected. The median counts, so the first run warms up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairloom.plans.catalog import QUERIES

HEADLINE = [
    # curation
    "jsonl_parse", "filter_sft", "filter_sft_columnar", "filter_grpo_profile",
    "filter_grpo_strict", "filter_token_budget", "curation_report", "filter_p90_length",
    # sampling and mixing
    "sample_bernoulli", "sample_exact", "cap_first_n", "cap_large_prefix", "shuffle_seeded", "batch_assign",
    "mixture",
    # shaping
    "sft_conversations", "chat_text_gemma", "chat_turns_gemma", "response_mask", "response_mask_ids",
    "pad_truncate", "pad_batch_longest",
    # scoring
    "script_profile", "reward_composite", "reward_total", "reward_group_stats",
    "reward_answer_loose", "rollouts_joined",
    # conversion and streaming
    "batch_convert_stub", "conversion_quality", "report_lines", "stream_curate",
]


def spread(spark: SparkSession, sf_dir: str, files: int) -> str:
    """Folder with the tables of ``sf_dir``, documents in several files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in Path(sf_dir).iterdir():
        if table.name != "documents.parquet":
            os.symlink(table, f"{folder}/{table.name}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartitionByRange(files, "doc_id").write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "0")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    tables = spread(spark, sf_dir, 2 * int(cpus))
    n_rows, n_chars = spark.read.parquet(f"{tables}/documents.parquet").agg(
        F.count("*"), F.sum(F.length("text"))
    ).first()
    prepared = time.perf_counter() - started
    times = {}
    for name in HEADLINE:
        own = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - started)
        times[name] = round(median(own), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "prepare_seconds": round(prepared, 3),
        "documents_per_second": {k: round(n_rows / t) for k, t in times.items()},
        "characters_per_second": {k: round(n_chars / t) for k, t in times.items()},
    }))


if __name__ == "__main__":
    main()
