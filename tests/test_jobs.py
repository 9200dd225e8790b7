"""The whole flow on a small business written out day by day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewise import jobs
from stagewise.errors import LedgerError
from stagewise.functions.calendar import calendar, extend_calendar
from stagewise.sources.ledger import Ledger
from stagewise.sources.raw import write_csv
from stagewise.sources.serve import served_files
from tests.conftest import make_star

FUNNEL = "fact_funnel_event"


def write_raw(spark, raw, base, late):
    """Raw files: per day 20 visits, 6 leads, 3 opportunities and 2 order lines; later days apart."""
    dates = extend_calendar(calendar(spark, *base), calendar(spark, *late))
    star = make_star(spark, "2024-11-18", "2024-11-18")
    for table, rows in (("dim_date", dates), ("dim_customer", star.dim_customer), ("dim_channel", star.dim_channel),
                        ("dim_product", star.dim_product)):
        write_csv(rows, f"{raw}/{table}", table)
    for span, suffix in ((base, ""), (late, "_new")):
        days = dates.filter(F.col("date").between(*[F.lit(d) for d in span])).select("date_key", "date")
        at = F.col("date").cast("timestamp") + F.expr("interval 9 hours")
        stage = F.when(F.col("n") < 20, "visit").when(F.col("n") < 26, "lead").otherwise("opportunity")
        many = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(28))).alias("n"))
        common = ["date_key", (F.col("n") % 3).alias("customer_key"), (F.col("n") % 2).alias("channel_key")]
        write_csv(many.select((F.col("date_key") * 100 + F.col("n")).cast("long").alias("event_key"), *common, stage.alias("stage"),
                              at.alias("event_ts")), f"{raw}/{FUNNEL}{suffix}", FUNNEL)
        lines = many.filter("n < 2").select(
            (F.col("date_key") * 100 + F.col("n")).cast("long").alias("order_line_key"), *common, F.col("n").alias("product_key"),
            F.when(F.col("n") == 0, 29.0).otherwise(99.0).alias("revenue"), F.lit(1).alias("quantity"), at.alias("order_ts"))
        write_csv(lines, f"{raw}/fact_orders{suffix}", "fact_orders")


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("flow")
    raw, root = str(base / "raw"), str(base / "tables")
    write_raw(spark, raw, (dt.date(2024, 11, 18), dt.date(2025, 1, 31)), (dt.date(2026, 1, 1), dt.date(2026, 2, 8)))
    jobs.load(spark, raw, root)
    return raw, root, jobs.evolve(spark, raw, root)


def test_load_makes_one_commit_per_month_and_one_for_the_batch(flow):
    commits = flow[2].timeline(FUNNEL).commits
    assert [(c.batch, c.operation, c.layout) for c in commits] == [
        ("2024-11", "overwrite", "day"), ("2024-12", "append", "day"), ("2025-01", "append", "day"),
        ("new", "append", "month")]
    assert commits[-1].added_files == 2 and commits[-1].total_files == 75 + 2
    assert [c.layout for c in flow[2].timeline("fact_orders")][-1] == "day"


def test_loading_the_batch_again_changes_nothing(spark, flow):
    raw, root, ledger = flow
    before = ledger.timeline(FUNNEL)
    assert jobs.evolve(spark, raw, root).timeline(FUNNEL) == before


def test_report(spark, flow):
    frames = jobs.report(spark, flow[1])
    assert all(r.ok for r in frames["catalogue"].collect())
    assert [r for r in frames["checks"].collect() if r.violations] == []
    assert frames["commits"].filter(F.col("table_name") == FUNNEL).count() == 3 + 1


def test_questions(spark, flow):
    root = flow[1]
    row = jobs.ask(spark, root, "funnel_yoy", stage="visit", iso_year=2026, iso_week=3)[0]
    assert row["prior_year_week"] == "2025-W03" and row["prior_year_events"] > 0
    assert row["provenance"]["snapshot_id"] == "4"
    commits = flow[2].timeline(FUNNEL).commits
    then = jobs.ask(spark, root, "compare_as_of", as_of_date=commits[-2].committed_at.isoformat(), stage="visit")[0]
    assert then["events_added_since"] > 0


def test_serving_copy(spark, flow, tmp_path):
    jobs.serve(spark, flow[1], str(tmp_path))
    copy = served_files(spark, str(tmp_path))
    assert copy.fact_funnel_event.count() == flow[2].timeline(FUNNEL).at().total_records


def test_kept_aggregates_give_the_same_answers(spark, flow):
    from stagewise.operators import funnel, rank, trends
    star = flow[2].star()
    asked = (lambda s: funnel.funnel_snapshot_all(s), lambda s: trends.weekly_trend(s, "revenue"),
             lambda s: funnel.funnel_yoy(s, "lead", 2026, 3), lambda s: rank.top_dimension(s))

    def rows(s):
        return [sorted(map(str, q(s).drop("provenance").collect())) for q in asked]

    plain = rows(star)
    with star.kept() as held:
        assert rows(held) == plain
        assert funnel.funnel_snapshot_all(held).count() == len(plain[0])
        frames = list(held._kept.values())
        assert len(frames) == 2 and all(f.is_cached for f in frames)
        assert sum(f.count() for f in frames) <= star.dim_date.count() * 4
    assert not any(f.is_cached for f in frames)


def test_unreadable_times_stop_a_load(spark, flow, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("event_key,date_key,customer_key,channel_key,stage,event_ts\n1,0,0,0,visit,soon\n")
    with pytest.raises(LedgerError, match="1 rows"):
        jobs._typed(spark, str(raw), FUNNEL)
    for name in ("dim_date", "dim_customer", "dim_channel", "dim_product"):
        (tmp_path / name).symlink_to(f"{flow[0]}/{name}")
    (tmp_path / FUNNEL).symlink_to(raw)
    with pytest.raises(LedgerError, match="1 rows"):
        jobs.load(spark, str(tmp_path), str(tmp_path / "tables"))


def test_arguments():
    assert jobs._pairs(["stage=lead", "iso_year=2026", "measure=visit,orders", "current=2026"]) == {
        "stage": "lead", "iso_year": 2026, "measure": ["visit", "orders"], "current": "2026"}
    with pytest.raises(SystemExit):
        jobs.main(["load"])
