"""Queries against their SQL on small tables made for what the supplied ones do not hold."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from spanloom.operators.slots import merged
from spanloom.plans import registry
from tests.test_oracles import rows

_START = datetime(2024, 1, 1)


def events(folder, found):
    """Rows (event_id, seconds, user_id, kind, value, k) as a table of events."""
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    made = [(i, _START + timedelta(seconds=s), user, kind, float(v), f'{{"k": {k}}}') for i, s, user, kind, v, k in found]
    pq.write_table(pa.table({n: [r[j] for r in made] for j, n in enumerate(names)}), f"{folder}/events.parquet")


def both(spark, folder, name):
    """Rows of the query and of its SQL over the tables of a folder."""
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = registry.queries()[name](spark, str(folder))
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return rows(got.columns, got.collect()), rows(columns, want.fetchall())


def test_ledger_scores_are_rounded_as_in_sql(spark, tmp_path):
    events(tmp_path, [(1, 0, 7, "view", 14.5, 1), (2, 10, 8, "error", 28.5, 1), (3, 20, 8, "click", 3.5, 1)])
    mine, theirs = both(spark, tmp_path, "abs_fusion_ledger")
    assert mine == theirs


def test_cut_behind_a_repeated_word(spark, tmp_path):
    words = [f"word{i}" for i in range(34)]
    words[21] = words[11]  # ten words from the twelfth on are cut out: the first and the next but one are alike
    pq.write_table(pa.table({"item_id": [1], "text": [" ".join(words)]}), f"{tmp_path}/benchmark.parquet")
    mine, theirs = both(spark, tmp_path, "seq_rediff")
    assert mine == theirs


def test_slot_scores_are_rounded_as_in_sql(spark, tmp_path):
    hour = 3600
    events(tmp_path, [(1, 9 * hour, 7, "view", 14.5, 1), (2, 10 * hour, 7, "purchase", 60, 1), (3, 11 * hour, 7, "click", 28.5, 1), (4, 12 * hour, 7, "view", 54.5, 1)])
    mine, theirs = both(spark, tmp_path, "seq_slot_resolve")
    assert mine == theirs


def test_levels_of_windows_are_rounded_as_in_sql(spark, tmp_path):
    # the level falls from 0.17 to 0.14 (or 0.15) and 0.11 behind the end: it fades, or else its scores are alike
    values, ks = (20, 20, 20, 20, 20, 20, 17, 14.5, 11), (5, 0, 5, 0, 0, 53, 0, 0, 0)
    found = [(i, 60 * i, 7, "purchase" if i == 1 else "view", v, k) for i, (v, k) in enumerate(zip(values, ks, strict=True), 1)]
    events(tmp_path, found)
    mine, theirs = both(spark, tmp_path, "win_bracket")
    assert mine == theirs and theirs


def test_slots_of_equal_fragments_do_not_depend_on_order(spark):
    rows = [(1, 0, 10, float(x), float(100 - x)) for x in range(9)] + [(1, 11, 20, 50.0, float(x)) for x in (7, 3, 9)]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        frame = spark.createDataFrame(order, "k long, start long, end long, left double, right double")
        assert [tuple(r) for r in merged(frame, ["k"]).collect()] == [(1, 0, 20, 0.0, 3.0)]


def test_slots_without_length_own_nothing(spark, tmp_path):
    # a view of no length lies within user 7's purchase alone, and within user 8's beside a proper one
    found = [(1, 0, 7, "purchase", 50, 1), (2, 600, 7, "view", 0.01, 40), (3, 0, 8, "purchase", 60, 1), (4, 300, 8, "view", 0, 40), (5, 3000, 8, "view", 5, 40)]
    events(tmp_path, found)
    mine, theirs = both(spark, tmp_path, "seq_slot_owned")
    assert mine == theirs and len(theirs) == 2


def test_vetoes_without_length_veto_nothing(spark, tmp_path):
    hour = 3600
    slot = [(1, 10 * hour, 7, "purchase", 60, 1), (2, 9 * hour, 7, "click", 90, 1), (3, 12 * hour, 7, "click", 90, 1), (4, 9 * hour + 1800, 7, "view", 100, 40)]
    for length, vetoed in ((0.01, False), (1, True)):
        events(tmp_path, [*slot, (5, 9 * hour + 2000, 7, "error", length, 1)])
        for name in ("seq_slot_resolve", "seq_slot_owned"):
            mine, theirs = both(spark, tmp_path, name)
            assert mine == theirs and ("vetoNewlyEnclosed" in next(iter(theirs))) == vetoed


def test_spans_without_length_have_no_owner(spark, tmp_path):
    events(tmp_path, [(1, 0, 7, "view", 60, 40), (2, 600, 7, "purchase", 0.01, 1), (3, 700, 7, "purchase", 5, 1)])
    mine, theirs = both(spark, tmp_path, "seq_slot_owned")
    assert mine == theirs and len(theirs) == 2
