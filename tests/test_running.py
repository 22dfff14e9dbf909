"""The stream with state: running extremes, late rows aside, keys that expire by timers and come back."""

import datetime as dt

from stallmark.streaming import running

DAY = dt.datetime(2024, 1, 1)


def at(day, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour)


def test_extremes_late_rows_and_expiry(spark, tmp_path):
    source, to, checkpoint = (str(tmp_path / x) for x in ("source", "out", "checkpoint"))
    batches = [
        [("a", at(0), at(0), 10.0), ("a", at(0), at(0, 1), 7.0), ("b", at(0), at(0), 5.0)],
        [("a", at(1), at(1), 12.0), ("a", at(-5), at(1), 1.0), ("a", None, at(1), 2.0), ("a", at(1), at(1), None)],
        # Five days on: b has been idle, and a has not come in since day one either.
        [("c", at(6), at(6), 3.0)],
        [("c", at(6), at(7), 4.0), ("b", at(7), at(7), 50.0)],
    ]
    for rows in batches:
        # Every start is a restart on the same checkpoint: state and timers come from there.
        spark.createDataFrame(rows, running.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = running.start(spark, source, to, checkpoint, dt.timedelta(days=2), dt.timedelta(days=3))
        query.awaitTermination()
        assert query.exception() is None
    got = spark.read.schema(running.OUTPUT).parquet(to).collect()
    told = {(r["key"], r["low"], r["high"], r["n"]) for r in got if r["kind"] == "running"}
    assert told == {("a", 7.0, 10.0, 2), ("b", 5.0, 5.0, 1), ("a", 7.0, 12.0, 3), ("c", 3.0, 3.0, 1), ("c", 3.0, 4.0, 2), ("b", 50.0, 50.0, 1)}
    late = sorted(((r["key"], r["ts"], r["price"]) for r in got if r["kind"] == "late"), key=str)
    assert late == sorted([("a", at(-5), 1.0), ("a", None, 2.0), ("a", at(1), None)], key=str)
    assert {(r["key"], r["low"], r["high"], r["n"]) for r in got if r["kind"] == "expired"} == {("a", 7.0, 12.0, 3), ("b", 5.0, 5.0, 1)}
    # One running row for a key and batch, one last word for each that expired.
    assert sum(r["kind"] == "running" for r in got) == 6 and sum(r["kind"] == "expired" for r in got) == 2
