"""Every query with SQL gives DuckDB's rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans import registry


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "as_integer_ratio") and not isinstance(x, int):  # decimals
        return round(float(x), 6)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows(spark, data, name):
    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = registry.queries()[name](spark, data)
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    assert theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
