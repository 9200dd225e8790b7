from stagewise.plans.catalogue import catalogue, run_catalogue
from stagewise.plans.views import (VIEWS, publish_views, vw_funnel_stage_trend, vw_funnel_weekly,
                                   vw_orders_trend, vw_week, vw_weekly_funnel)
from tests.conftest import day


def rows(frame, *keys):
    return {tuple(r[k] for k in keys): r for r in frame.collect()}


def test_partial_weeks_are_flagged(star_of):
    got = rows(vw_week(star_of("2022-01-01", "2022-01-11")), "iso_year", "iso_week")
    assert {k: (r.days_observed, r.is_complete_week) for k, r in got.items()} == {
        (2021, 52): (2, False), (2022, 1): (7, True), (2022, 2): (2, False)}
    assert got[2021, 52].week_start_date == day("2021-12-27")


def test_funnel_counts_and_rates(star_of):
    star = star_of("2026-01-05", "2026-01-18",
                   events=[("2026-01-05", "visit", 8), ("2026-01-07", "visit", 2),
                           ("2026-01-07", "lead", 4), ("2026-01-08", "opportunity", 1),
                           ("2026-01-12", "visit", 5)],
                   orders=[("2026-01-06", 10.5), ("2026-01-06", 0.25), ("2026-01-11", 1)])
    got = rows(vw_funnel_weekly(star), "iso_week")
    full, empty = got[(2,)], got[(3,)]
    assert (full.visits, full.leads, full.opportunities, full.orders) == (10, 4, 1, 3)
    assert full.revenue == 11.75
    assert (full.visit_to_lead_pct, full.lead_to_opp_pct, full.opp_to_order_pct,
            full.visit_to_order_pct) == (40.0, 25.0, 300.0, 30.0)
    # a real zero is 0, a missing denominator is unknown
    assert (empty.visit_to_lead_pct, empty.lead_to_opp_pct, empty.opp_to_order_pct) == (0.0, None, None)
    assert (empty.orders, empty.revenue) == (0, 0.0)


def test_weeks_with_orders_only_are_left_out_of_the_funnel(star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 1)],
                   orders=[("2026-01-12", 5)])
    assert [r.iso_week for r in vw_funnel_weekly(star).collect()] == [2]
    assert [r.iso_week for r in VIEWS["vw_weekly_orders"](star).collect()] == [3]


def test_events_of_unknown_days_are_dropped(spark, star_of):
    star = star_of("2026-01-05", "2026-01-11", events=[("2026-01-05", "visit", 3)])
    stray = spark.createDataFrame([(99, 9999, 0, 0, "visit", None)], star.fact_funnel_event.schema
                                  .fromJson({**star.fact_funnel_event.schema.jsonValue(),
                                             "fields": [{**f, "nullable": True} for f in
                                                        star.fact_funnel_event.schema.jsonValue()["fields"]]}))
    more = star.with_tables(fact_funnel_event=star.fact_funnel_event.unionByName(stray))
    assert [r.events for r in vw_weekly_funnel(more).collect()] == [3]


def test_year_over_year_never_skips_a_year(star_of):
    star = star_of("2024-01-01", "2026-12-31",
                   events=[("2024-03-04", "lead", 10), ("2026-03-02", "lead", 5)])
    got = rows(vw_funnel_stage_trend(star), "iso_year", "iso_week")
    assert set(got) == {(2024, 10), (2026, 10)}
    assert got[2026, 10].events_last_year is None and got[2026, 10].yoy_pct is None
    assert got[2026, 10].events_prior_week == 10  # the week present before it


def test_week_53_has_no_counterpart(star_of):
    star = star_of("2025-01-01", "2026-12-31",
                   events=[("2025-12-24", "visit", 4), ("2026-12-30", "visit", 6)])
    got = rows(vw_funnel_stage_trend(star), "iso_year", "iso_week")
    assert got[2026, 53].events_last_year is None


def test_orders_trend(star_of):
    star = star_of("2025-01-06", "2026-01-18",
                   orders=[("2025-01-08", 100), ("2025-01-15", 50), ("2026-01-07", 75),
                           ("2026-01-07", 75)])
    got = rows(vw_orders_trend(star), "iso_year", "iso_week")
    assert got[2025, 3].revenue_wow_pct == -50.0
    assert (got[2026, 2].orders_last_year, got[2026, 2].orders_yoy_pct) == (1, 100.0)
    assert got[2026, 2].revenue_yoy_pct == 50.0


def test_running_totals_start_again_with_each_period(star_of):
    star = star_of("2025-12-29", "2026-01-06",
                   orders=[("2025-12-30", 1), ("2025-12-31", 2), ("2026-01-02", 4), ("2026-01-05", 8)])

    def totals(name):
        return [r[2] for r in catalogue()[name](star).collect()]

    assert totals("orders_wtd") == [1, 2, 3, 1]
    assert totals("orders_mtd") == [1, 2, 1, 2]
    assert totals("revenue_wtd") == [1.0, 3.0, 7.0, 8.0]
    assert totals("revenue_ytd") == [1.0, 3.0, 4.0, 12.0]


def test_catalogue_reports_every_query(star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2)],
                   orders=[("2026-01-06", 3)])
    got = run_catalogue(star).collect()
    assert len(got) == 15 and all(r.ok for r in got)


def test_catalogue_goes_on_after_a_failure(star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2)])
    broken = star.with_tables(fact_orders=star.fact_orders.drop("revenue"))
    got = {r.name: r for r in run_catalogue(broken).collect()}
    assert got["events_wtd"].ok and not got["revenue_ytd"].ok and got["revenue_ytd"].error


def test_views_answer_sql(spark, star_of):
    star = star_of("2026-01-05", "2026-01-18", events=[("2026-01-05", "visit", 2)])
    assert len(publish_views(star)) == 12
    assert spark.sql("SELECT sum(events) AS n FROM vw_weekly_funnel").first().n == 2
