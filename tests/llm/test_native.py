"""Native operators run no Python, and texts are shuffled at most once."""

import re

import pytest

from evenload.llm import registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_sharding", "op4_secrets", "op9_url_filter", "op10_mixing"])
def test_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(registry.QUERIES[name](spark, DIR)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan(registry.QUERIES[name](spark, DIR)))


def test_scans_read_what_is_needed(spark):
    scan = plan(registry.QUERIES["op1_line_dedup"](spark, DIR))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", registry.QUERIES["op1_line_dedup"](spark, DIR)._jdf.queryExecution().toString() + scan)) <= {"struct<doc_id:bigint,text:string>"}
