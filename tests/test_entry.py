"""What the driver calls."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["project_id", "cue_no", "start", "end", "text"]


def test_tables_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "a10_srt_cues" in entry.queries()
