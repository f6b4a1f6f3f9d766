"""Plan properties that must hold for every registered query (checked on the physical plan)."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_SMALL

QUERIES = entry_mod.queries()


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_flagship_plan_shape(spark):
    text = plan_text(QUERIES["event_chunk_pairs"](spark, SF_SMALL))
    assert "WindowGroupLimit" in text            # per-group limit before the second exchange
    assert "SortAggregate" not in text           # fixed-width hash aggregates only
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text   # no Python in the hot path
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text   # pruned scan


def test_readme_coverage_lists_every_query():
    import os
    import re
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    coverage = readme[readme.index("## Coverage"):readme.index("## Verification")]
    named = set(re.findall(r"`([a-z_0-9]+)`", coverage))
    assert set(QUERIES) <= named
