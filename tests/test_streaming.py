"""A stream gives the sessions of the batch operator."""

import datetime as dt

from lexmill.operators.ordered import idle_sessions
from lexmill.streaming.sessions import append_new, new_lines, run_once, stream_sessions


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 1), (1, t0 + dt.timedelta(minutes=60), 2), (1, t0 + dt.timedelta(minutes=121), 3), (2, t0, 4), (9, t0 + dt.timedelta(days=9), 5)]
    e = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    e.write.parquet(str(tmp_path / "in"))
    run_once(stream_sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "ts", 60), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.user_id, r.began, r.ended, r.events) for r in idle_sessions(e, "user_id", "ts", "event_id", 60).where("user_id < 9").collect()}
    assert got == batch and len(batch) == 3


def test_journal_stream_and_state(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    run_once(new_lines(spark, str(tmp_path / "j"), "k int"), str(tmp_path / "o"), str(tmp_path / "s"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]
    first = append_new(spark.createDataFrame([(1,), (1,), (2,)], "k int"), str(tmp_path / "seen"), "k")
    first.write.parquet(str(tmp_path / "seen"))
    assert [r.k for r in append_new(spark.createDataFrame([(2,), (3,)], "k int"), str(tmp_path / "seen"), "k").collect()] == [3]
