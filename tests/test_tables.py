"""The derived tables: whole texts are reduced before anything is shuffled."""

import pytest

from dupstream.sources import tables as TB
from tests.conftest import SF0001


def _joined_columns(node):
    """Names of the columns that go into any join of the plan."""
    found = set()
    inner = [node.children().apply(i) for i in range(node.children().size())]
    for child in inner:
        if node.nodeName() == "Join":
            found |= {child.output().apply(i).name() for i in range(child.output().size())}
        found |= _joined_columns(child)
    return found


@pytest.mark.parametrize("build", [TB._posts_fx, TB._images_fx, TB.api_records])
def test_no_whole_text_goes_into_a_join(spark, build):
    columns = _joined_columns(build(spark, SF0001)._jdf.queryExecution().optimizedPlan())
    assert "doc_id" in columns and "text" not in columns


def test_documents_meet_events_once(spark):
    """Posts and API records start from the stored join, with the rows of the join itself."""
    for fx, build in ((TB.posts_fx, TB._posts_fx), (TB.records_fx, TB.api_records)):
        df, joined = fx(spark, SF0001), build(spark, SF0001)
        assert not _joined_columns(df._jdf.queryExecution().optimizedPlan())
        assert df.schema == joined.schema and df.exceptAll(joined).isEmpty() and joined.exceptAll(df).isEmpty()
