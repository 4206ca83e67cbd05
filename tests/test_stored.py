"""What a query writes to the shared folder before it answers."""

import pytest

import __spark_entry__ as entry
from hearthpanel import session


@pytest.mark.parametrize("name, unwritten", [("features_retired", "panel_full"), ("mean_by_age_method", "panel_ana")])
def test_frames_read_once_are_not_written(spark, small, name, unwritten):
    source = small.replace("sf0.001", "./" * (1 + len(name)) + "sf0.001")  # a source no other test has stored
    assert entry.queries()[name](spark, source).count() > 0
    written = {table for _, folder, table in session._WRITTEN if folder == source}
    assert "panel" in written and unwritten not in written
