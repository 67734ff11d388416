"""The library without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import __spark_entry__ as entry
from tests.oracle import make_session
assert not [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
assert set(entry.oracle_sql()) <= set(entry.queries())
spark = make_session("apart", "2")
assert entry.entry(spark).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    ran = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")},
                         capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2_000:]


def test_a_session_needs_no_duckdb():
    hidden = "import sys; sys.modules['duckdb'] = None; from tests.oracle import make_session"
    ran = subprocess.run([sys.executable, "-c", hidden], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2_000:]
