"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from pairloom.plans.catalog import CHECKS, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare



def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SMALL, QUERIES[name], CHECKS[name]) == []


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "line_no", "kanji_text", "katakana_text", "ratio"]
    assert rows.count() > 0
