"""What the plans must and must not hold."""

import re
from pathlib import Path

import pytest

from loomframe.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")

#: Queries that call Python, with the number of their Python nodes in the last plan.
PYTHON_BOUNDARY = {"stub_inference_resume": 1, "inference_with_failures": 1, "encoded_images": 1, "model_projection": 1, "byte_pair_chats": 1, "batch_sizes_swept": 0, "pixel_features": 1, "image_replies": 1, "movie_durations": 1, "spliced_features": 0}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_BOUNDARY:
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    else:
        assert len(re.findall(r"(?:MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython) ", text)) == PYTHON_BOUNDARY[name]


def test_scans_read_only_what_is_asked(spark):
    text = plan(catalog.QUERIES["resume_anti_join"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text and "ReadSchema: struct<doc_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["best_checkpoint"](spark, DATA).where("event_type = 'click'"))
    assert "EqualTo(event_type,click)" in text


def test_top_k_per_group_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["sample_k_per_group"](spark, DATA))
