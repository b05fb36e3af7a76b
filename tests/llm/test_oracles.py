"""Every corpus query with SQL gives DuckDB's rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from spanloom.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_rows(spark, data, name):
    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, data)
    want = db.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = (Counter(map(tuple, x)) for x in (got.select(columns).collect(), want.fetchall()))
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
