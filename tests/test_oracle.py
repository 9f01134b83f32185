"""Every query with a SQL twin gives the same rows, names and types as DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    verdict, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert verdict == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["supplier", "mail_type", "item_count", "receiver", "first_expiry", "last_expiry", "attach_pdf"]
    assert {r[0] for r in df.select("mail_type").distinct().collect()} == {"KEEP_CHECK", "NOTICE", "UPCOMING"}
