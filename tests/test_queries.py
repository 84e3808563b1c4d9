"""Every registered query runs; those with SQL give the SQL's rows."""

import pytest

from lodestar.plans import QUERIES, SQL
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_repair_keeps_long_replies(spark, tmp_path):
    spark.sql("SELECT 2L AS event_id, 'click' AS event_type, concat('{\"k\":\"', repeat('x', 5000), '\"}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    (got,) = QUERIES["json_repair"](spark, str(tmp_path)).collect()
    assert "x" * 5000 in got.text and got.text.endswith("}]}")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
