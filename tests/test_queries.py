"""Every registered query against DuckDB, or for rows where SQL can't say it."""

from __future__ import annotations

import pytest
from compare import difference

from cuemill.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(map(str.lower, df.columns))) == len(df.columns)
    if name in ORACLE_SQL:
        assert difference(df, ORACLE_SQL[name], sf) is None
    else:
        assert df.count() > 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
