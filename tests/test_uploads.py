"""Counters that are sent: once each, again after a failure, later after more of them."""

from spanloom.streaming import uploads as up

ROWS = "counter string, cohort string, n long"


def test_delta_and_envelope(spark):
    totals = spark.createDataFrame([("a", "x", 5), ("a", "y", 2), ("b", "x", 1), ("c", "x", 9), (None, "x", 1)], ROWS)
    sent = spark.createDataFrame([("a", "x", 3), ("a", "y", 2), ("d", "x", 4)], ROWS)
    found = up.delta(totals, sent, ["counter", "cohort"])
    assert {tuple(r) for r in found.collect()} == {("a", "x", 2), ("b", "x", 1), ("c", "x", 9), (None, "x", 1)}
    assert {tuple(r) for r in up.envelope(found, {"a": None, "c": ["y"]}).collect()} == {("a", "x", 2)}


def test_backoff():
    assert [up.backoff(f, 10.0, 500.0) for f in (0, 1, 2, 5, 6, 99)] == [10.0, 20.0, 40.0, 320.0, 500.0, 500.0]


def test_uploads(spark, tmp_path):
    now, received, broken = [0.0], {}, [False]

    def send(rows, key):
        if broken[0]:
            raise OSError("no network")
        received[key] = {(r.counter, r.cohort): r.n for r in rows.collect()}

    uploader = up.Uploader(f"{tmp_path}/up", send, {"a": None, "b": ["x"]}, least=10.0, most=100.0, clock=lambda: now[0])
    batch = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert uploader.flush(spark) == "nothing pending"
    uploader(batch(("a", "x", 1), ("a", "x", 2), ("b", "y", 7)), 0)
    assert uploader.outcome == "sent" and received == {"1": {("a", "x"): 3}}
    now[0] = 20.0
    uploader(batch(("a", "x", 1), ("a", "x", 2), ("b", "y", 7)), 0)  # the batch comes again
    assert uploader.outcome == "nothing pending"
    broken[0] = True
    uploader(batch(("a", "x", 4)), 1)
    assert (uploader.outcome, uploader.failures) == ("failed", 1)
    broken[0], now[0] = False, 35.0  # ten seconds twice over have not passed
    uploader(batch(("b", "x", 5)), 2)
    assert uploader.outcome == "too soon"
    now[0] = 41.0
    assert uploader.flush(spark) == "sent" and uploader.failures == 0
    assert received == {"1": {("a", "x"): 3}, "2": {("a", "x"): 4, ("b", "x"): 5}}
    restarted = up.Uploader(f"{tmp_path}/up", send, {"a": None}, clock=lambda: now[0])
    assert restarted.flush(spark) == "nothing pending"


def test_a_stream_of_increments(spark, tmp_path):
    got = []
    uploader = up.Uploader(f"{tmp_path}/up", lambda rows, key: got.extend(tuple(r) for r in rows.collect()), {"a": None}, least=0.0)
    for i in range(3):
        spark.createDataFrame([("a", "x", i + 1), ("z", "x", 1)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(uploader).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(n for _, _, n in got) == 6 and {c for c, _, _ in got} == {"a"}
