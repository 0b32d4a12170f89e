"""Every query of the engine against its SQL in DuckDB."""

import pytest

import __spark_entry__
from tests.conftest import SMALL
from tidemark.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert name in ORACLE_SQL
    theirs = sorted(repr(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert ours == theirs


def test_published_months_are_one_file_in_many_partitions(spark, duck):
    """Tables so large for their partitions that adaptive execution puts together fewer of one shuffle than of the other."""
    own = {"advisoryPartitionSizeInBytes": "3000b", "coalescePartitions.minPartitionSize": "1b", "coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in own}
    for k, v in own.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        test_query_equals_sql(spark, duck, "q63_published")
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
