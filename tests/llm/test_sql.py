"""Queries with SQL, row by row against another engine."""

import pytest
from compare import connect, rows_of

from tilespark.llm.oracles import ORACLES
from tilespark.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cur = connect(sf_dir).execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())
