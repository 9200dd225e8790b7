"""Streams over raw files: kept counts, delivery by key, and what they refuse."""

import datetime as dt

from pyspark.sql import functions as F

from stagewise.streaming import daily, unique

HEADER = "event_key,date_key,customer_key,channel_key,stage,event_ts\n"
FUNNEL = "fact_funnel_event"


def deliver(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    part = folder / name
    part.write_text(HEADER + "".join(f"{line}\n" for line in lines))
    at = dt.datetime.now().timestamp() + len(list(folder.iterdir()))  # files are taken in the order of their times
    import os

    os.utime(part, (at, at))


def event(key, day, stage="visit", time="10:00:00"):
    return f"{key},0,5,0,{stage},{day} {time}"


def counts(spark, root):
    return {(str(r.day), r.stage): r.events for r in daily.daily_counts(spark, root).collect()}


def refused(spark, root):
    return {(r.reason, str(r.day), r.stage): r.events for r in daily.refused_counts(spark, root).collect()}


def test_counts_grow_over_triggers_and_runs(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "kept")
    run = lambda: daily.stream_daily(spark, str(raw), root, "10 days", 1).awaitTermination()
    deliver(raw, "a.csv", event(1, "2026-01-01"), event(2, "2026-01-01"), event(3, "2026-01-02", "lead"), "4,0,5,0,visit,n/a")
    deliver(raw, "b.csv", event(5, "2026-01-01"), event(6, "2026-01-05"))
    run()
    assert counts(spark, root) == {("2026-01-01", "visit"): 3, ("2026-01-02", "lead"): 1, ("2026-01-05", "visit"): 1}
    assert refused(spark, root) == {("unreadable", "None", None): 1}
    run()  # nothing new
    deliver(raw, "c.csv", event(7, "2026-01-02", "lead"), "x,0,5,0,visit,2026-01-02")
    run()
    assert counts(spark, root) == {("2026-01-01", "visit"): 3, ("2026-01-02", "lead"): 2, ("2026-01-05", "visit"): 1}
    assert refused(spark, root) == {("unreadable", "None", None): 2}


def test_a_day_behind_the_watermark_is_closed_and_its_rows_are_counted_as_late(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "kept")
    run = lambda: daily.stream_daily(spark, str(raw), root, "2 days", 1).awaitTermination()
    deliver(raw, "a.csv", event(1, "2026-01-01"), event(2, "2026-01-09"))  # one trigger: nothing is late
    run()
    assert refused(spark, root) == {}
    # the watermark is the 7th at 10:00, so the 6th is closed and the 7th is not
    deliver(raw, "b.csv", event(3, "2026-01-06"), event(4, "2026-01-06"), event(5, "2026-01-07", time="00:00:01"), event(6, "2026-01-01"))
    run()
    assert counts(spark, root) == {("2026-01-01", "visit"): 1, ("2026-01-09", "visit"): 1, ("2026-01-07", "visit"): 1}
    assert refused(spark, root) == {("late", "2026-01-06", "visit"): 2, ("late", "2026-01-01", "visit"): 1}


def test_rows_are_added_up_before_the_state_is_asked(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "kept")
    deliver(raw, "a.csv", *[event(i, "2026-01-01") for i in range(25_000)])
    query = daily.stream_daily(spark, str(raw), root)
    query.awaitTermination()
    assert counts(spark, root) == {("2026-01-01", "visit"): 25_000}
    state = query.recentProgress[0]["stateOperators"][0]
    assert state["numRowsUpdated"] == 1


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    root = str(tmp_path / "kept")
    daily.stream_daily(spark, str(tmp_path / "raw"), root).awaitTermination()
    assert counts(spark, root) == {} and refused(spark, root) == {}


def test_each_key_is_delivered_once_over_triggers_and_restarts(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "out")
    run = lambda: unique.stream_unique(spark, FUNNEL, str(raw), root, "event_key", "4 days", 1)
    deliver(raw, "a.csv", event(1, "2026-01-01"), event(2, "2026-01-02"), event(1, "2026-01-01"))
    deliver(raw, "b.csv", event(2, "2026-01-02"), event(3, "2026-01-03"), "4,0,5,0,visit,n/a")
    run().awaitTermination()
    run().awaitTermination()
    deliver(raw, "c.csv", event(3, "2026-01-03"), event(1, "2026-01-01"), event(5, "2026-01-04"))
    run().awaitTermination()
    got = unique.unique_events(spark, FUNNEL, root)
    assert sorted(r.event_key for r in got.collect()) == [1, 2, 3, 5]
    assert [(r.event_key, r.reasons) for r in unique.undelivered(spark, FUNNEL, root).collect()] == [(4, ["event_ts is not a time"])]


def test_state_ends_with_the_watermark(spark, tmp_path):
    """Old keys leave the state, and a row far behind is dropped and told of in the progress."""
    raw, root = tmp_path / "raw", str(tmp_path / "out")
    for i, day in enumerate(("01-01", "02-01", "03-01")):
        deliver(raw, f"{i}.csv", *[event(100 * i + j, f"2026-{day}") for j in range(20)])
    deliver(raw, "late.csv", event(999, "2026-01-01"))
    query = unique.stream_unique(spark, FUNNEL, str(raw), root, "event_key", "4 days", 1)
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) <= 40
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert unique.unique_events(spark, FUNNEL, root).count() == 60


def test_disk_state_leaves_the_settings_of_the_session(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with unique.disk_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before
