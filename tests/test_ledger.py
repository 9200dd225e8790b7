import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewise import answers
from stagewise.errors import LedgerError, MetricError
from stagewise.operators import history
from stagewise.operators.provenance import REQUIRED
from stagewise.schemas import FACT_FUNNEL_EVENT
from stagewise.sources.ledger import Ledger, Timeline, parse_moment
from tests.conftest import files_opened, make_star

UTC = dt.timezone.utc
FUNNEL = "fact_funnel_event"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def events(spark, *rows):
    """``(event_key, stage, moment)``"""
    return spark.createDataFrame([(k, 0, 0, 0, stage, at(when)) for k, stage, when in rows],
                                 FACT_FUNNEL_EVENT)


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    """Two commits in January by day, a late one, one by month."""
    held = Ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    held.append(FUNNEL, events(spark, (1, "lead", "2026-01-05T08:00:00"), (2, "visit", "2026-01-06T08:00:00"),
                               (3, "lead", "2026-01-12T08:00:00")), at("2026-02-01T06:00:00"))
    held.append(FUNNEL, events(spark, (4, "lead", "2026-01-13T23:59:59.999999")), at("2026-02-01T18:00:00.250000"))
    held.append(FUNNEL, events(spark, (5, "lead", "2026-01-05T09:00:00")), at("2026-02-03T06:00:00"))
    held.evolve(FUNNEL, "month")
    held.append(FUNNEL, events(spark, (6, "lead", "2026-01-14T00:00:00"), (7, "visit", "2026-02-01T00:00:00")),
                at("2026-02-04T06:00:00"))
    return held


def keys(frame):
    return sorted(r.event_key for r in frame.collect())


def test_every_snapshot_stays_readable(ledger):
    assert keys(ledger.read(FUNNEL)) == [1, 2, 3, 4, 5, 6, 7]
    assert [keys(ledger.read(FUNNEL, n)) for n in (1, 2, 3)] == [[1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5]]
    with pytest.raises(LedgerError, match="held: \\[1, 2, 3, 4\\]"):
        ledger.read(FUNNEL, 9)
    with pytest.raises(LedgerError, match="no snapshots"):
        ledger.read("fact_orders")


def test_moments():
    assert parse_moment("2026-02-01") == (at("2026-02-02T00:00:00"), False)
    assert parse_moment("2026-02-01T06:00:00Z") == (at("2026-02-01T06:00:00"), True)
    assert parse_moment("2026-02-01T07:00:00+01:00") == (at("2026-02-01T06:00:00"), True)
    with pytest.raises(LedgerError, match="soon"):
        parse_moment("soon")


@pytest.mark.parametrize("moment, snapshot", [
    ("2026-02-01", 2), ("2026-02-01T06:00:00", 1), ("2026-02-01T05:59:59+00:00", None),
    ("2026-02-02", 2), ("2026-02-03", 3), ("2030-01-01", 4), ("2026-01-31", None)])
def test_as_of(spark, ledger, moment, snapshot):
    line = ledger.timeline(FUNNEL)
    if snapshot is None:
        with pytest.raises(LedgerError, match="2026-02-01T06:00:00"):
            line.as_of(moment)
    else:
        assert line.as_of(moment).snapshot_id == snapshot
    asked = spark.createDataFrame([(moment,)], "as_of string")
    assert ledger.resolve_moments(FUNNEL, asked).first().snapshot_id == snapshot


def test_as_of_only_grows(ledger):
    line = ledger.timeline(FUNNEL)
    moments = [at("2026-02-01T06:00:00") + dt.timedelta(hours=7 * n) for n in range(15)]
    sizes = [line.as_of(m).total_records for m in moments]
    assert sizes == sorted(sizes) and sizes[-1] == 7


def test_time_travel_is_not_a_date_filter(ledger):
    row = history.compare_as_of(ledger, "2026-02-02", "lead").first()
    assert (row.historical_events, row.current_events, row.events_added_since) == (3, 5, 2)
    # commit 3 holds an event of 5 January, which a date filter over today's rows would count
    early = ledger.read(FUNNEL).filter((F.col("stage") == "lead") & (F.col("event_ts") < "2026-01-14"))
    assert early.count() == 4
    with pytest.raises(MetricError, match="run from"):
        history.compare_as_of(ledger, "2026-01-31")


def test_partition_range_opens_only_its_files(ledger):
    whole, week = ledger.read(FUNNEL), (at("2026-01-05T00:00:00"), at("2026-01-12T00:00:00"))
    assert files_opened(whole) == [2, 5]
    pruned = ledger.time_range(FUNNEL, *week)
    assert keys(pruned) == [1, 2, 5]
    assert files_opened(pruned) == [1, 3]
    outside = ledger.time_range(FUNNEL, at("2027-01-01T00:00:00"), at("2027-02-01T00:00:00"))
    assert keys(outside) == [] and sum(files_opened(outside)) == 0


@pytest.mark.parametrize("start, end, want", [
    ("2026-01-13T23:59:59.999999", "2026-01-14T00:00:00", [4]),
    ("2026-01-14T00:00:00", "2026-02-01T00:00:00", [6]),
    ("2026-01-05T08:00:00", "2026-01-05T09:00:00", [1]),
    ("2026-01-01T00:00:00", "2026-03-01T00:00:00", [1, 2, 3, 4, 5, 6, 7])])
def test_ranges_are_half_open_in_every_layout(ledger, start, end, want):
    assert keys(ledger.time_range(FUNNEL, at(start), at(end))) == want


def test_reads_across_layouts_match_an_unpartitioned_read(ledger):
    parts = [f.select("event_key", "stage", "event_ts") for _, f in ledger.parts(FUNNEL)]
    both = ledger.read(FUNNEL).select("event_key", "stage", "event_ts")
    whole = parts[0].unionByName(parts[1])
    assert both.exceptAll(whole).isEmpty() and whole.exceptAll(both).isEmpty()


def test_history(ledger):
    rows = history.snapshot_history(ledger).collect()
    assert [(r.snapshot_id, r.operation, r.total_records, r.is_current) for r in rows] == [
        (1, "overwrite", 3, False), (2, "append", 4, False), (3, "append", 5, False), (4, "append", 7, True)]


def test_failed_writes_are_never_seen_and_their_ids_not_reused(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    held.append(FUNNEL, events(spark, (1, "lead", "2026-01-05T08:00:00")), at("2026-02-01T06:00:00"))
    line = held.timeline(FUNNEL)
    lost = events(spark, (8, "lead", "2026-01-05T08:00:00"), (9, "lead", "2026-01-06T08:00:00"))
    held._write(line, lost.withColumn("commit_id", F.lit(2)), [2])  # stops before its ledger row
    assert keys(held.read(FUNNEL)) == [1]
    again = held.append(FUNNEL, events(spark, (8, "lead", "2026-01-05T08:00:00")))
    assert again.snapshot_id == 3 and keys(held.read(FUNNEL)) == [1, 8]


def test_overwrite_hides_older_rows_but_keeps_their_snapshots(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    held.append(FUNNEL, events(spark, (1, "lead", "2026-01-05T08:00:00"), (2, "lead", "2026-01-06T08:00:00")), at("2026-02-01T06:00:00"))
    held.overwrite(FUNNEL, events(spark, (3, "lead", "2026-01-05T08:00:00")), at("2026-02-02T06:00:00"))
    assert keys(held.read(FUNNEL)) == [3] and keys(held.read(FUNNEL, 1)) == [1, 2]
    row = history.compare_as_of(held, "2026-02-01").first()
    assert (row.historical_events, row.current_events, row.events_added_since) == (2, 1, -1)


def test_commits_stay_in_order(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    one = events(spark, (1, "lead", "2026-01-05T08:00:00"))
    held.append(FUNNEL, one, at("2026-02-01T06:00:00"))
    with pytest.raises(LedgerError, match="not after"):
        held.append(FUNNEL, one, at("2026-02-01T06:00:00"))
    assert keys(held.read(FUNNEL)) == [1]


def test_empty_commits_and_tables(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    nothing = events(spark, (1, "lead", "2026-01-05T08:00:00")).limit(0)
    held.append(FUNNEL, nothing)
    assert keys(held.read(FUNNEL)) == []
    assert held.timeline(FUNNEL).at().total_files == 0
    assert keys(held.time_range(FUNNEL, at("2026-01-01T00:00:00"), at("2026-02-01T00:00:00"))) == []
    held.append(FUNNEL, events(spark, (1, "lead", "2026-01-05T08:00:00")))
    assert keys(held.read(FUNNEL)) == [1]


def test_layouts(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    assert Timeline(FUNNEL, ()).layout == (0, "day") and Timeline("dim_date", ()).layout == (0, "none")
    assert held.evolve(FUNNEL, "month") == (0, "month")
    assert held.evolve(FUNNEL, "month") == (0, "month")
    assert held.evolve(FUNNEL, "day") == (1, "day")
    with pytest.raises(LedgerError, match="hour"):
        held.evolve(FUNNEL, "hour")
    assert held.log(FUNNEL).isEmpty()


def test_one_commit_per_month_in_one_job(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    rows = events(spark, (1, "lead", "2025-12-31T23:59:59"), (2, "lead", "2026-02-01T00:00:00"), (3, "lead", "2026-02-28T00:00:00"))
    commits = held.load_by_month(FUNNEL, rows, at("2026-03-01T00:00:00"))
    assert [(c.batch, c.operation, c.added_records, c.total_records, c.added_files) for c in commits] == [
        ("2025-12", "overwrite", 1, 1, 1), ("2026-02", "append", 2, 3, 2)]
    assert keys(held.read(FUNNEL, 1)) == [1] and keys(held.read(FUNNEL)) == [1, 2, 3]
    again = held.load_by_month(FUNNEL, rows.filter("event_key > 1"), at("2026-03-02T00:00:00"))
    assert again[0].deleted_files == 3 and keys(held.read(FUNNEL)) == [2, 3]
    untimed = rows.withColumn("event_ts", F.lit(None).cast("timestamp"))
    with pytest.raises(LedgerError, match="3 rows"):
        held.load_by_month(FUNNEL, untimed)


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    """Half of all rows on one day: the engine splits it, and every row arrives."""
    held = Ledger(spark, str(tmp_path))
    n = 40_000
    rows = spark.range(n).select(
        F.col("id").alias("event_key"), F.lit(0).alias("date_key"), F.col("id").alias("customer_key"),
        F.lit(0).alias("channel_key"), F.md5(F.col("id").cast("string")).alias("stage"),
        F.when(F.col("id") % 2 == 0, F.lit("2026-01-05")).otherwise(
            F.date_add(F.lit("2026-01-06").cast("date"), (F.col("id") % 7).cast("int")).cast("string"))
        .cast("timestamp").alias("event_ts"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        held.append(FUNNEL, rows)
    finally:
        spark.conf.set(key, before)
    assert held.read(FUNNEL).count() == n
    hot = held.in_layout_range(FUNNEL, at("2026-01-05T00:00:00"), at("2026-01-06T00:00:00"))[0]
    assert hot.select("_metadata.file_path").distinct().count() > 1


def test_provenance_names_the_snapshots_behind_a_number(spark, tmp_path):
    source = make_star(spark, "2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2), ("2026-01-12", "visit", 1)],
                       orders=[("2026-01-12", 5)])
    held = Ledger(spark, str(tmp_path))
    held.load_dimensions(source, at("2026-02-01T00:00:00"))
    held.append(FUNNEL, source.fact_funnel_event, at("2026-02-01T00:00:00"))
    held.append("fact_orders", source.fact_orders, at("2026-02-02T00:00:00"))
    star = held.star()
    asked = {"funnel_yoy": {"stage": "visit"}, "compare_as_of": {"as_of_date": "2026-02-03", "stage": "visit"},
             "period_compare": {"measure": "visit", "grain": "week", "current": "2026-W03"},
             "running_total": {"measure": ["visit", "orders"]}, "daily_trend": {"measure": "visit"}, "daily_trend_points": {"measure": "visit"},
             "weekly_trend": {"measure": "visit"}, "funnel_anomalies": {"threshold_pct": 1}}
    for metric in answers.METRICS:
        for row in answers.answer(metric, star, held, **asked.get(metric, {})):
            assert set(REQUIRED) <= set(row["provenance"])
            assert row["provenance"]["snapshot_id"]
    row = answers.answer("running_total", star, measure=["visit", "orders"])[0]["provenance"]
    assert {(s["snapshot_id"], s["snapshot_committed_at"], tuple(s["measures"])) for s in row["snapshots"]} == {
        ("1", dt.datetime(2026, 2, 1), ("visit",)), ("1", dt.datetime(2026, 2, 2), ("orders",))}
    with pytest.raises(LedgerError):
        held.star("2026-02-01")  # the order fact did not exist yet


def test_day_keys_reach_the_scan(spark, tmp_path):
    """A question about one week filters the stored fact by constants."""
    source = make_star(spark, "2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2), ("2026-01-12", "visit", 1)])
    held = Ledger(spark, str(tmp_path))
    held.load_dimensions(source)
    held.append(FUNNEL, source.fact_funnel_event)
    held.append("fact_orders", source.fact_orders)
    from stagewise.operators.funnel import funnel_yoy
    plan = funnel_yoy(held.star(), "visit")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(date_key" in plan


def test_a_week_opens_only_its_files_without_trusting_keys(spark, tmp_path):
    """Keys bound the days to open; a row whose key and time disagree is still counted."""
    from stagewise.operators.funnel import funnel_snapshot
    source = make_star(spark, "2026-01-05", "2026-02-01", events=[
        (f"2026-01-{d:02d}", "visit", 1) for d in range(5, 32)], orders=[("2026-01-13", 5)])
    held = Ledger(spark, str(tmp_path))
    held.load_dimensions(source)
    held.append(FUNNEL, source.fact_funnel_event)
    held.append("fact_orders", source.fact_orders)
    line = held.timeline(FUNNEL)
    origin = (dt.date(2026, 1, 5) - dt.date(1970, 1, 1)).days
    assert line.at().day_from_key == [origin, origin]
    assert line.day_span([7, 13]) == (dt.date(2026, 1, 12), dt.date(2026, 1, 18))
    week = held.on_days(FUNNEL, range(7, 14))
    assert sum(files_opened(week)) == 7 and week.count() == 7
    one = funnel_snapshot(held.star(), 2026, 3)
    assert one.first().visit == 7 and one.first()["order"] == 1
    assert sum(files_opened(one.drop("provenance"))) <= 7 + 1 + 2 * 1  # weeks read dim_date twice

    # three rows of day 30 Jan carry the key of 13 Jan
    stray = source.fact_funnel_event.limit(3).withColumn("date_key", F.lit(8)).withColumn(
        "event_ts", F.lit("2026-01-30 12:00:00").cast("timestamp"))
    held.append(FUNNEL, stray)
    assert held.timeline(FUNNEL).at().day_from_key == [origin + 17, origin + 17]
    assert funnel_snapshot(held.star(), 2026, 3).first().visit == 10
    # without a time nothing is known, and everything is read
    held.append(FUNNEL, stray.withColumn("event_ts", F.lit(None).cast("timestamp")))
    assert held.timeline(FUNNEL).at().day_from_key is None
    assert held.timeline(FUNNEL).day_span([7]) is None
    assert funnel_snapshot(held.star(), 2026, 3).first().visit == 13


def test_a_commit_reads_the_end_of_the_log_only(spark, tmp_path):
    held = Ledger(spark, str(tmp_path))
    for n in range(5):
        held.append(FUNNEL, events(spark, (n, "lead", "2026-01-05T08:00:00")), at(f"2026-02-01T06:0{n}:00"), batch=f"b{n}")
    held.evolve(FUNNEL, "month")
    tip, line = held._tip(FUNNEL, "b1"), held.timeline(FUNNEL)
    assert [c.batch for c in tip] == ["b1", "b4"] and tip.layout == line.layout and tip.commits[-1] == line.commits[-1]
    assert held.append(FUNNEL, events(spark, (9, "lead", "2026-01-05T08:00:00")), batch="b1").snapshot_id == line.commits[1].snapshot_id
    assert held.append(FUNNEL, events(spark, (9, "lead", "2026-01-05T08:00:00")), batch="b9").layout == "month"
    assert len(held.timeline(FUNNEL)) == 6 and held.read(FUNNEL).count() == 6
