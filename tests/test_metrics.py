import pytest

from stagewise import answers
from stagewise.errors import MetricError
from stagewise.operators import checks, funnel, periods, rank, trends
from stagewise.operators.provenance import REQUIRED, require_provenance
from tests.conftest import day


@pytest.fixture
def two_years(star_of):
    return star_of("2024-01-01", "2026-12-31",
                   events=[("2025-03-05", "lead", 4), ("2026-03-04", "lead", 6),
                           ("2026-03-11", "lead", 3), ("2024-03-04", "visit", 1)],
                   orders=[("2026-03-04", 10), ("2026-03-05", 30)])


def test_same_week_of_the_year_before(two_years):
    row = funnel.funnel_yoy(two_years, "Lead ", 2026, 10).first()
    assert (row.week, row.prior_year_week) == ("2026-W10", "2025-W10")
    assert (row.current_events, row.prior_year_events, row.delta) == (6, 4, 2)
    assert (row.yoy_pct, row.direction, row.note) == (50.0, "up", None)
    spans = row.provenance.date_range
    assert (spans.start, spans.prior_start) == (day("2026-03-02"), day("2025-03-03"))


def test_missing_year_is_unknown_not_zero(two_years):
    row = funnel.funnel_yoy(two_years, "lead", 2026, 11).first()
    assert (row.prior_year_events, row.delta, row.yoy_pct, row.direction) == (None, None, None, "unknown")
    assert "2025" in row.note


def test_prior_dates_come_from_the_calendar_across_a_53_week_year(star_of):
    star = star_of("2026-01-01", "2027-12-31", events=[("2027-01-06", "visit", 2), ("2026-01-01", "visit", 1)])
    row = funnel.funnel_yoy(star, "visit", 2027, 1).first()
    assert row.provenance.date_range.prior_start == day("2025-12-29")
    assert (row.week_start_date - row.provenance.date_range.prior_start).days == 53 * 7


def test_arguments_are_checked_before_any_job(two_years):
    with pytest.raises(MetricError, match="purchase"):
        funnel.funnel_yoy(two_years, "purchase")
    with pytest.raises(MetricError, match="unknown measure"):
        trends.weekly_trend(two_years, "avg_deal_size")
    with pytest.raises(MetricError, match="period must be"):
        trends.running_total(two_years, "orders", "qtd")
    with pytest.raises(MetricError, match="average"):
        trends.running_total(two_years, "avg_deal_size")
    with pytest.raises(MetricError, match="no measure"):
        trends.running_total(two_years, [])
    with pytest.raises(MetricError, match="dimension"):
        rank.top_dimension(two_years, "country")
    with pytest.raises(MetricError, match="measure"):
        rank.top_dimension(two_years, "region", "visit")
    with pytest.raises(MetricError, match="grain"):
        periods.period_compare(two_years, grain="decade")


def test_funnel_snapshot(star_of):
    star = star_of("2026-01-05", "2026-01-11",
                   events=[("2026-01-05", "visit", 10), ("2026-01-05", "lead", 4), ("2026-01-06", "opportunity", 2)],
                   orders=[("2026-01-07", 10.125), ("2026-01-07", 5), ("2026-01-07", 5)])
    row = funnel.funnel_snapshot(star).first()
    assert (row.visit, row.lead, row.opportunity, row["order"], row.revenue) == (10, 4, 2, 3, 20.13)
    assert (row.visit_to_lead_pct, row.opportunity_to_order_pct) == (40.0, 150.0)
    assert (row.visit_to_lead_drop_pct, row.opportunity_to_order_drop_pct) == (60.0, -50.0)
    assert funnel.funnel_snapshot_all(star).drop("provenance").collect() == [row[:-1]]


def test_weekly_trend_lag_is_taken_before_the_limit(star_of):
    star = star_of("2026-01-05", "2026-02-01",
                   events=[("2026-01-05", "lead", 4), ("2026-01-19", "lead", 6), ("2026-01-26", "lead", 3)])
    got = trends.weekly_trend(star, "lead", 2).collect()
    assert [(r.week, r.value, r.wow_pct, r.prior_week_gap_days) for r in got] == [
        ("2026-W04", 6.0, 50.0, 14), ("2026-W05", 3.0, -50.0, 7)]
    with pytest.raises(MetricError, match="1 or more"):
        trends.weekly_trend(star, "lead", 0)


def test_running_total_year_cuts_the_iso_week(star_of):
    star = star_of("2025-12-29", "2026-01-06", orders=[("2025-12-30", 1), ("2026-01-02", 4)])
    whole = trends.running_total(star, "orders", "wtd").collect()
    cut = trends.running_total(star, "orders", "wtd", year=2026).collect()
    assert [r.running_total for r in whole] == [1.0, 2.0]
    assert [r.running_total for r in cut] == [1.0]


def test_running_total_of_several_measures(star_of):
    star = star_of("2026-01-05", "2026-01-11", events=[("2026-01-05", "visit", 2), ("2026-01-06", "visit", 3)],
                   orders=[("2026-01-06", 2.5)])
    got = trends.running_total_latest(star, ["revenue", "visit", "revenue"], "wtd").collect()
    assert {(r.measure, r.date, r.value, r.running_total) for r in got} == {
        ("visit", day("2026-01-06"), 3.0, 5.0), ("revenue", day("2026-01-06"), 2.5, 2.5)}
    series = trends.running_total(star, ["revenue", "visit"], "wtd").collect()
    assert [(r.measure, r.is_latest) for r in series] == [("revenue", True), ("visit", False), ("visit", True)]


def test_daily_trend_skips_or_fills_empty_days(star_of):
    star = star_of("2026-01-01", "2026-01-20", events=[("2026-01-05", "lead", 4), ("2026-01-08", "lead", 1)])
    assert [r.value for r in trends.daily_trend(star, "lead", 30).collect()] == [4.0, 1.0]
    assert [r.value for r in trends.daily_trend(star, "lead", 30, dense=True).collect()] == [4.0, 0.0, 0.0, 1.0]
    row = trends.daily_trend_summary(star, "lead", 30).first()
    assert (row.total, row.average_per_day, row.change_pct, row.days_returned) == (5.0, 2.5, -75.0, 2)
    assert "2026-01-08" in row.note
    assert trends.daily_trend_summary(star, "lead", 2).first().note is None


def test_daily_average_deal_size(star_of):
    star = star_of("2026-01-01", "2026-01-20", orders=[("2026-01-05", 10), ("2026-01-05", 5), ("2026-01-06", 1)])
    row = trends.daily_trend_summary(star, "avg_deal_size", 30).first()
    assert (row.total, row.average_per_day, row.first_value, row.last_value) == (8.5, 4.25, 7.5, 1.0)


def test_ranking_merges_labels_and_breaks_ties_by_name(star_of):
    star = star_of("2026-01-05", "2026-01-11",
                   orders=[("2026-01-05", 5, 1), ("2026-01-05", 5, 2), ("2026-01-06", 10, 0), ("2026-01-06", 1, 3)])
    got = rank.top_dimension(star, "product", "revenue", limit=3).collect()
    assert [(r.name, r.value, r.orders) for r in got] == [("Pro", 10.0, 2), ("Starter", 10.0, 1), ("Alpha", 1.0, 1)]
    best = rank.top_dimension(star, "product", "avg_deal_size", limit=1).collect()
    assert [(r.name, r.value) for r in best] == [("Starter", 10.0)]
    with pytest.raises(MetricError, match="1 or more"):
        rank.top_dimension(star, "product", "orders", limit=0)
    assert len(rank.top_dimension(star, "product", "orders", limit=500).collect()) == 3


def test_ranking_by_customer_attributes_and_per_week(star_of):
    star = star_of("2026-01-05", "2026-01-18",
                   orders=[("2026-01-05", 5, 0, 0), ("2026-01-05", 5, 0, 1), ("2026-01-06", 10, 0, 2), ("2026-01-12", 1, 0, 1)])
    got = rank.top_dimension(star, "region", "orders", 2026, 2).collect()
    assert [(r.name, r.orders, r.revenue, r.avg_deal_size) for r in got] == [
        ("North", 2, 15.0, 7.5), ("South", 1, 5.0, 5.0)]
    bulk = rank.top_dimension_all(star, "segment", "orders", 1).collect()
    assert {(r.week, r.name) for r in bulk} == {("2026-W02", "SMB"), ("2026-W03", "Enterprise")}


@pytest.fixture
def quarter_star(star_of):
    return star_of("2025-11-01", "2026-06-30",
                   events=[("2025-12-01", "lead", 5), ("2026-01-31", "lead", 2), ("2026-04-15", "lead", 1)],
                   orders=[("2025-12-01", 100), ("2026-02-28", 50)])


def test_two_latest_complete_periods(quarter_star):
    row = periods.period_compare(quarter_star, "lead", "month").first()
    # April is cut at the 15th; March lies inside the data and has a real zero
    assert (row.current, row.current_value, row.current_complete) == ("2026-03", 0.0, True)
    assert (row.previous, row.previous_value) == ("2026-02", 0.0)
    assert (row.delta, row.pct_change, row.direction) == (0.0, None, "unknown")
    assert row.note.startswith("no change can be given: 2026-02")


def test_named_and_preceding_periods(quarter_star):
    row = periods.period_compare(quarter_star, "lead", "month", "2026-1").first()
    assert (row.current, row.previous, row.delta, row.pct_change) == ("2026-01", "2025-12", -3.0, -60.0)
    row = periods.period_compare(quarter_star, "lead", "month", "2025-12", "2026-4").first()
    assert (row.current_value, row.previous_value, row.previous_complete) == (5.0, 1.0, False)
    assert row.note.startswith("incomplete in the data: 2026-04;")
    row = periods.period_compare(quarter_star, "lead", "month", "2026-06").first()
    assert (row.current_value, row.delta, row.pct_change) == (None, None, None)
    assert row.note.startswith("incomplete in the data: 2026-06, 2026-05;")


def test_previous_alone_is_overridden(quarter_star):
    row = periods.period_compare(quarter_star, "lead", "month", None, "2025-12").first()
    assert (row.current, row.previous) == ("2026-03", "2026-02")


def test_unknown_periods_name_the_ones_available(quarter_star):
    with pytest.raises(MetricError, match="current month 2031-01 is unknown"):
        answers.answer("period_compare", quarter_star, measure="lead", current="2031-01")
    with pytest.raises(MetricError, match="previous month 2050-01 is unknown"):
        answers.answer("period_compare", quarter_star, measure="lead", current="2026-1", previous="2050-01")
    first = quarter_star.dim_date.orderBy("date").first().date.strftime("%Y-%m")
    with pytest.raises(MetricError, match=f"{first} is the earliest month"):
        answers.answer("period_compare", quarter_star, measure="lead", current=first)
    with pytest.raises(MetricError, match="two complete years of lead are needed"):
        answers.answer("period_compare", quarter_star, measure="lead", grain="year")


def test_truncated_period_passes_unless_strict(star_of):
    star = star_of("2026-01-01", "2026-12-31", events=[("2026-01-01", "visit", 1), ("2026-12-31", "visit", 2)])
    loose = {r.current: r for r in periods.period_changes(star, "visit", "week").collect()}
    strict = {r.current: r for r in periods.period_changes(star, "visit", "week", strict=True).collect()}
    assert loose["2026-W53"].current_complete and not strict["2026-W53"].current_complete
    assert strict["2026-W52"].current_complete


def test_many_comparisons_at_once(spark, quarter_star):
    asked = spark.createDataFrame([(1, "2026-1", "2025-12"), (2, "2026-2", "2026-01"), (3, "1999-1", "2026-01"), (4, "2026-01", "2025-12")],
                                  "request int, current string, previous string")
    got = {r.request: (r.delta, r.note) for r in periods.compare_requests(quarter_star, asked, "lead", "month").collect()}
    assert {k: v for k, (v, _) in got.items()} == {1: -3.0, 2: -2.0, 3: None, 4: -3.0}
    assert got[3][1] == "unknown current month: 1999-01"


def test_anomaly_threshold_is_inclusive_and_only_drops_count(star_of):
    star = star_of("2026-01-05", "2026-01-18",
                   events=[("2026-01-05", "visit", 1000), ("2026-01-12", "visit", 800),
                           ("2026-01-05", "lead", 1000), ("2026-01-12", "lead", 801),
                           ("2026-01-05", "opportunity", 10), ("2026-01-12", "opportunity", 14)])
    got = funnel.funnel_anomalies(star).collect()
    assert [(r.kind, r.name, r.change_pct) for r in got] == [("stage_volume", "visit", -20.0)]
    assert got[0].message == "visit volume: down 20% (1,000 before, 800 now)"
    assert (got[0].current_week, got[0].previous_week) == ("2026-W03", "2026-W02")
    assert funnel.anomaly_status(star) == ("2026-W03", "2026-W02", None)
    assert len(funnel.funnel_anomalies(star, -19.9).collect()) == 2


def test_anomalies_that_cannot_be_found_say_why(star_of):
    alone = star_of("2026-01-05", "2026-01-11", events=[("2026-01-05", "visit", 1)])
    assert funnel.anomaly_status(alone)[2] == "2025-12-29 is outside the calendar"
    silent = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 1)])
    assert funnel.anomaly_status(silent)[2] == "no funnel events recorded for 2026-W03"
    assert funnel.funnel_anomalies(silent).collect() == []


def test_conversion_message(star_of):
    star = star_of("2026-01-05", "2026-01-18",
                   events=[("2026-01-05", "visit", 8), ("2026-01-05", "lead", 4),
                           ("2026-01-12", "visit", 8), ("2026-01-12", "lead", 2)])
    got = {r.name: r.message for r in funnel.funnel_anomalies(star).collect()}
    assert got["visit_to_lead"] == "visit → lead conversion: down 50% (50.0% before, 25.0% now)"


def test_no_data_is_an_error_with_a_reason(star_of):
    star = star_of("2026-01-05", "2026-01-18")
    for metric in ("funnel_snapshot", "running_total", "daily_trend", "top_dimension"):
        with pytest.raises(MetricError):
            answers.answer(metric, star)
    assert answers.answer("weekly_trend", star) == []
    with pytest.raises(MetricError, match="unknown metric"):
        answers.answer("forecast", star)
    with pytest.raises(MetricError, match="versioned"):
        answers.answer("snapshot_history", star)


def test_answers_without_receipts_are_refused(star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 1)])
    frame = trends.daily_trend(star, "visit")
    assert set(REQUIRED) <= set(frame.schema["provenance"].dataType.fieldNames())
    with pytest.raises(MetricError, match="provenance"):
        require_provenance(frame.drop("provenance"))
    with pytest.raises(MetricError, match="calculation"):
        require_provenance(frame.withColumn("provenance", frame.provenance.dropFields("calculation")))


def test_checks_find_what_is_wrong(spark, star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 3), ("2026-01-06", "lead", 1)],
                   orders=[("2026-01-06", 3, 77)])
    got = {r.check: (r.rows_checked, r.violations) for r in checks.contract_check(star).collect()}
    assert got["fact_orders.product_key in dim_product"] == (1, 1)
    assert got["fact_funnel_event.date_key in dim_date"] == (4, 0)
    assert got["fact_funnel_event.stage not null"] == (4, 0)
    assert got["dim_date.date unique"] == (14, 0)
    assert {r.check: r.violations for r in checks.yoy_pair_check(star).collect()} == {
        "yoy_pairs_same_week": 0, "yoy_missing_prior_is_unknown": 0, "yoy_note_only_when_unknown": 0}
    assert all(r.violations == 0 for r in checks.rate_null_check(star).collect())


def test_checks_of_empty_tables_still_answer(star_of):
    star = star_of("2026-01-05", "2026-01-06")
    got = {r.check: (r.rows_checked, r.violations) for r in checks.contract_check(star).collect()}
    assert got["fact_orders.customer_key in dim_customer"] == (0, 0)
    assert len(got) == 46
