"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from check_oracle import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
# Results that may be empty on the smallest tables.
SPARSE = {"in_range_sites", "sample_segments", "segment_classes", "site_screen_counts", "final_record_filter"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name)
    assert ok or (name in SPARSE and "rows 0 / 0" in note), note


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["site_no", "year", "q5", "norm_q5"] and df.count() > 0
