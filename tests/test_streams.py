"""Streams that stop and go on: offsets, merged rows, dropped state."""

import datetime as dt

from quarry.streaming import streams as T

DAY = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, DAY + dt.timedelta(days=d), u, k, v, None) for i, d, u, k, v in rows], schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_upsert_goes_on_where_it_stopped(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    run = lambda: T.upsert(T.events(spark, source + "/*").select("user_id", "at", "event_id"), table, ["user_id"], "at").trigger(availableNow=True).start()
    write(spark, source, "a", [(1, 0, 7, "view", 1.0), (2, 1, 7, "view", 1.0), (3, 0, 8, "view", 1.0)])
    run().awaitTermination()
    assert {(r.user_id, r.event_id) for r in T.upserted(spark, table).collect()} == {(7, 2), (8, 3)}
    write(spark, source, "b", [(4, 0, 7, "view", 1.0), (5, 3, 8, "view", 1.0), (6, 3, 9, "view", 1.0)])
    q = run()
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 3  # only what is new is read
    assert {(r.user_id, r.event_id) for r in T.upserted(spark, table).collect()} == {(7, 2), (8, 5), (9, 6)}


def test_state_is_kept_and_dropped(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    run = lambda: T.upsert(T.session_state(T.events(spark, source + "/*").select("event_id", "user_id", "event_type", "value", "at"), "2 days"), table, ["user_id"]).trigger(availableNow=True).start()
    write(spark, source, "a", [(1, 0, 7, "purchase", 9.0), (2, 0, 7, "error", 1.5), (3, 0, 8, "view", 1.0)])
    run().awaitTermination()
    write(spark, source, "b", [(4, 1, 7, "view", 2.0), (5, 30, 9, "view", 1.0)])
    run().awaitTermination()
    got = {r.user_id: (r.events, r.errors, r.since_purchase) for r in T.upserted(spark, table).collect()}
    assert got == {7: (3, 1, 3.5), 8: (1, 0, 1.0), 9: (1, 0, 1.0)}
    write(spark, source, "c", [(6, 31, 7, "view", 4.0), (7, 1, 8, "view", 1.0)])  # 7 was forgotten; 8's row is too late
    run().awaitTermination()
    got = {r.user_id: (r.events, r.errors, r.since_purchase) for r in T.upserted(spark, table).collect()}
    assert got == {7: (1, 0, 4.0), 8: (1, 0, 1.0), 9: (1, 0, 1.0)}


def test_windows_drop_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, "a", [(1, 0, 7, "view", 1.0), (2, 0, 7, "view", 2.0), (3, 5, 7, "view", 3.0)])
    out = T.drained(T.windowed(T.events(spark, source + "/*"), width="2 days", slide="1 day"), "w", "update", ["start", "event_type"])
    assert sorted((r.n, r.v) for r in out.collect()) == [(1, 3.0), (1, 3.0), (2, 3.0), (2, 3.0)]


def test_handlers(spark, tmp_path):
    source, got = str(tmp_path / "in"), []
    write(spark, source, "a", [(1, 0, 7, "view", 1.0), (2, 0, 7, "error", 2.0), (3, 0, 8, "error", 3.0), (4, 0, 8, "click", 3.0)])
    note = lambda name: lambda rows, number: got.append((name, number, rows.count()))
    q = T.handled(T.events(spark, source + "/*"), {"view": note("seen"), "error": note("failed"), "purchase": note("paid")})
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == [("failed", 0, 2), ("seen", 0, 1)]
