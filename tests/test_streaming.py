"""Streams over files, run until all input is read."""

import datetime as dt

from quernstone.operators.series import status_changes
from quernstone.streaming import events

T = dt.datetime(2024, 1, 1)


def rows(n=60):
    kinds = ["view", "click", "error"]
    return [(i, T + dt.timedelta(minutes=7 * i), i % 4, kinds[(i // 5) % 3], float(i), "{}") for i in range(n)]


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_status_transitions_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    whole = spark.createDataFrame(rows(), events.EVENTS)
    for a in (0, 20, 40):
        spark.createDataFrame(rows()[a : a + 20], events.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(events.status_transitions(events.read_events(spark, str(tmp_path / "in"), 1)), "transitions")
    got = {r.event_id for r in spark.table("transitions").collect()}
    want = {r.event_id for r in status_changes(whole, ["user_id"], ["ts", "event_id"], "event_type").collect()}
    assert got == want


def test_windows_and_sessions(spark, tmp_path):
    spark.createDataFrame(rows(), events.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    drain(events.windowed_counts(stream), "hourly", "complete")
    assert sum(r.n for r in spark.table("hourly").collect()) == 60
    drain(events.windowed_counts(events.read_events(spark, str(tmp_path / "in")), "1 hour", "30 minutes"), "sliding", "complete")
    assert sum(r.n for r in spark.table("sliding").collect()) == 120
    drain(events.sessions(events.read_events(spark, str(tmp_path / "in")), "20 minutes"), "sessions", "complete")
    assert sum(r.n for r in spark.table("sessions").collect()) == 60
