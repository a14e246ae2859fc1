"""Operators: functions from DataFrames to DataFrames, for use with ``DataFrame.transform``.

Relations of words, captions and the like are keyed by ``key`` (``project_id``)
and ordered by ``pos``.  Tables that :mod:`cuemill.adapters` makes are dealt by
the key before they are exploded, so that the windows and groupings here find
their rows in place and need no further shuffle.
"""
