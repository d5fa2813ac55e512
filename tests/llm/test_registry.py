"""The registered queries run on whole tables and equal their SQL."""

import pytest

from evenload.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, matches, name):
    df = registry.QUERIES[name](spark, DIR)
    if name in registry.ORACLES:
        matches(df, registry.ORACLES[name])
    else:
        source = spark.read.parquet(f"{DIR}/documents.parquet")
        assert df.count() == source.count()
