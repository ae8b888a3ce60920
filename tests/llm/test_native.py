"""Operators that must stay in built-in functions."""

from pathlib import Path

import pytest

from loomframe.llm.sharding import op10_sharding
from loomframe.llm.url_filter import op6_url_filters

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("query", [op6_url_filters, op10_sharding])
def test_no_python_on_the_path(spark, query):
    text = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_urls_are_judged_without_a_join(spark):
    text = op6_url_filters(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
