"""Compare registered queries with DuckDB.

As a script: ``python -m tests.oracle [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

if TYPE_CHECKING:
    import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_session(name: str = "checks", cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import duckdb  # here, as sessions are made where it may be missing

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, list):
        return tuple(_value(i) for i in x)
    return x


def _kind(x):
    return type(x).__name__


def compare(spark: SparkSession, con, sf_dir: str, run, sql: str) -> list[str]:
    """Differences between the query and its check, empty if equal."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(_value(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    at = [names.index(c) for c in columns]
    theirs = [tuple(_value(r[i]) for i in at) for r in cursor.fetchall()]
    if not ours:
        return ["no rows"]
    problems = []
    for i, c in enumerate(columns):
        kinds = {_kind(r[i]) for r in ours} - {"NoneType"}, {_kind(r[i]) for r in theirs} - {"NoneType"}
        if kinds[0] != kinds[1]:
            problems.append(f"{c}: {kinds[0]} against {kinds[1]}")
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        extra, lost = a - b, b - a
        problems.append(f"{len(ours)} rows against {len(theirs)}, columns {columns}")
        problems += [f"  ours   {r}"[:600] for r in list(extra)[:2]]
        problems += [f"  theirs {r}"[:600] for r in list(lost)[:2]]
    return problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or queries:
        started = time.time()
        try:
            problems = compare(spark, con, sf_dir, queries[name], checks[name])
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", flush=True)
        for p in problems:
            print("    ", p)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
