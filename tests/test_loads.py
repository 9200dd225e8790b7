import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewise.errors import LedgerError
from stagewise.plans.views import vw_funnel_weekly
from stagewise.schemas import FACT_TIME, TABLES
from stagewise.sources import serve
from stagewise.sources.ledger import Ledger
from stagewise.sources.raw import load_csv, load_table, write_csv
from stagewise.streaming.append import append_files, commit_batch
from tests.conftest import make_star

FUNNEL = "fact_funnel_event"
HEADER = "event_key,date_key,customer_key,channel_key,stage,event_ts\n"


def write(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text(HEADER + "".join(f"{line}\n" for line in lines))


def test_times_in_several_spellings_and_none(spark, tmp_path):
    write(tmp_path / "raw", "a.csv", "1,0,5,0,visit,2022-01-03 07:05:00", "2,0,5,0,visit,2026-01-03T07:05",
          "3,0,5,0,visit,n/a", "4,0,5,0,visit,07:05", "5,0,5,0,visit,", "6,0,5,0,visit,2026-02-30")
    good, bad = load_table(spark, str(tmp_path / "raw"), FUNNEL)
    times = {r.event_key: r.t for r in good.select("event_key", F.date_format("event_ts", "yyyy-MM-dd HH:mm").alias("t")).collect()}
    assert times == {1: "2022-01-03 07:05", 2: "2026-01-03 07:05"}
    assert sorted(r.event_key for r in bad.collect()) == [3, 4, 5, 6]
    assert dict(good.dtypes)["event_ts"] == "timestamp" and dict(bad.dtypes)["event_ts"] == "string"


def test_raw_files_round_trip(spark, tmp_path):
    star = make_star(spark, "2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2)], orders=[("2026-01-12", 5.25)])
    for table in TABLES:
        path = str(tmp_path / table)
        write_csv(star.table(table), path, table)
        back, rejected = load_table(spark, path, table)
        assert (rejected is None) == (table not in FACT_TIME)
        assert sorted(map(str, back.collect())) == sorted(map(str, star.table(table).collect()))


def test_types_are_not_inferred(spark, tmp_path):
    write(tmp_path / "raw", "a.csv", "1,0,5,0,visit,2022-01-03 07:05:00")
    assert dict(load_csv(spark, str(tmp_path / "raw"), FUNNEL).dtypes)["event_ts"] == "string"


def test_stream_appends_each_file_once(spark, tmp_path):
    raw, ledger = tmp_path / "raw", Ledger(spark, str(tmp_path / "tables"))

    def run():
        append_files(ledger, FUNNEL, str(raw), str(tmp_path / "cp"), "raw", str(tmp_path / "bad"),
                     max_files=1).awaitTermination()

    write(raw, "a.csv", "1,0,5,0,visit,2022-01-03 07:05:00", "2,0,5,0,lead,n/a")
    write(raw, "b.csv", "3,0,5,0,visit,2022-01-04 07:05:00")
    run()
    run()
    assert sorted(r.event_key for r in ledger.read(FUNNEL).collect()) == [1, 3]
    assert [c.batch for c in ledger.timeline(FUNNEL)] == ["raw:0", "raw:1"]
    write(raw, "c.csv", "4,0,5,0,visit,2022-01-05T07:05")
    run()
    assert sorted(r.event_key for r in ledger.read(FUNNEL).collect()) == [1, 3, 4]
    assert [r.event_key for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_a_replayed_batch_commits_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "tables"))
    write(tmp_path / "raw", "a.csv", "1,0,5,0,visit,2022-01-03 07:05:00")
    raw = load_csv(spark, str(tmp_path / "raw"), FUNNEL)
    for _ in range(2):
        commit_batch(ledger, FUNNEL, "raw", str(tmp_path / "bad"), raw, 7)
    assert len(ledger.timeline(FUNNEL)) == 1 and ledger.read(FUNNEL).count() == 1


def test_serving_copy(spark, tmp_path):
    star = make_star(spark, "2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2)], orders=[("2026-01-06", 5.25)])
    for _ in range(2):  # replaced, not appended
        serve.serve_files(star, str(tmp_path))
    copy = serve.served_files(spark, str(tmp_path))
    assert copy.fact_funnel_event.count() == 2
    assert vw_funnel_weekly(copy).collect() == vw_funnel_weekly(star).collect()


def test_serving_types_are_kept(spark, tmp_path):
    assert serve.column_types("dim_date") == "date DATE, week_start_date DATE"
    assert serve.column_types("fact_orders") == "order_ts TIMESTAMP"
    assert serve.column_types("dim_channel") == ""
    frame = make_star(spark, "2026-01-05", "2026-01-06").dim_date
    with pytest.raises(LedgerError, match="date: StringType"):
        serve.require_types(frame.withColumn("date", F.col("date").cast("string")), "dim_date")


def test_dimensions_are_replaced(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    first = make_star(spark, "2026-01-05", "2026-01-06")
    second = make_star(spark, "2026-01-05", "2026-01-10")
    ledger.load_dimensions(first, dt.datetime(2026, 2, 1))
    ledger.load_dimensions(second, dt.datetime(2026, 2, 2))
    assert ledger.read("dim_date").count() == 6 and ledger.read("dim_date", 1).count() == 2
