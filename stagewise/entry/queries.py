"""Every registered query: ``name -> (spark, folder) -> DataFrame``.

Provenance holds the time of the run, so it is left out of the frames compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.entry.published import fresh_folder, published
from stagewise.functions.calendar import GRAINS, extend_calendar, normalise_period, period_label
from stagewise.functions.ratios import change, direction, share
from stagewise.operators import checks, funnel, history, periods, rank, trends, weeks
from stagewise.plans.catalogue import catalogue, run_catalogue
from stagewise.plans.daily import weekly_stages
from stagewise.plans.views import VIEWS, publish_views, vw_funnel_weekly
from stagewise.schemas import DIMENSIONS, FACT_TIME, MONEY
from stagewise.session import use_utc
from stagewise.sources.bindings import event_star, orders_star, read_source
from stagewise.sources.ledger import Ledger
from stagewise.sources.raw import load_table, normalise_times, write_csv
from stagewise.sources.serve import serve_files, served_files
from stagewise.star import Star
from stagewise.streaming.append import append_files

Query = Callable[[SparkSession, str], DataFrame]
FUNNEL, ORDERS = "fact_funnel_event", "fact_orders"
UTC = dt.timezone.utc


def the_star(spark: SparkSession, root: str) -> Star:
    """The orders star of a folder as it is now: lazy frames, nothing kept."""
    use_utc(spark)
    return orders_star(spark, root)


def on_star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, root: build(the_star(spark, root)).drop("provenance")


def on_ledger(build: Callable[[Ledger], DataFrame]) -> Query:
    return lambda spark, root: build(published(spark, root)).drop("provenance")


def moment(column: str | Column) -> Column:
    """A timestamp as wall-clock time in UTC."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


# --- calendar -------------------------------------------------------------------

def ship_days(spark: SparkSession, root: str) -> DataFrame:
    """The days orders were shipped: some lie past the calendar of the star."""
    lines = read_source(spark, root, "lineitem")
    return lines.select(F.to_date("l_shipdate").alias("date")).distinct()


def dim_date_extend(spark: SparkSession, root: str) -> DataFrame:
    star = the_star(spark, root)
    return extend_calendar(star.dim_date, ship_days(spark, root))


def period_labels(star: Star) -> DataFrame:
    return star.dim_date.select("date", *[period_label(g).alias(g) for g in GRAINS])


def latest_week(basis: str) -> Query:
    return on_star(lambda s: weeks.latest_complete_week(s, basis).drop("date_keys"))


def resolve_week(spark: SparkSession, root: str) -> DataFrame:
    star = the_star(spark, root)
    asked = ship_days(spark, root).select(
        F.extract(F.lit("YEAROFWEEK"), "date").cast("int").alias("iso_year"),
        F.weekofyear("date").alias("iso_week")).distinct()
    return weeks.resolve_weeks(star, asked)


def week_containing(spark: SparkSession, root: str) -> DataFrame:
    return weeks.weeks_containing(the_star(spark, root), ship_days(spark, root))


def normalised(spark: SparkSession, root: str) -> DataFrame:
    """Each order day named in loose spellings, and the canonical period of each."""
    orders = read_source(spark, root, "orders")
    day = F.col("date")
    named = orders.select(F.to_date("o_orderdate").alias("date")).distinct().select(
        "date",
        F.concat_ws("-", F.year(day), F.month(day)).alias("month"),
        F.concat(F.lit("q"), F.quarter(day), F.lit(" "), F.year(day)).alias("quarter"),
        F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("w"), F.weekofyear(day)).alias("week"),
        F.concat(F.lit(" "), F.year(day), F.lit(" ")).alias("year"))
    unknown = F.concat(F.lit(" "), F.date_format(day, "MMMM"), F.lit(" "), F.year(day))
    return named.select("date", *[normalise_period(F.col(g), g).alias(f"{g}_period") for g in GRAINS],
                        normalise_period(unknown, "month").alias("unknown_period"))


def pct_helpers(star: Star) -> DataFrame:
    v, n, o = F.col("visits"), F.col("leads"), F.col("opportunities")
    return weekly_stages(star).select(
        "iso_year", "iso_week", share(n, v).alias("lead_share"), share(v, o).alias("visit_share"),
        change(o, n).alias("step_change"), change(v, o).alias("back_change"),
        direction(change(o, n)).alias("step_direction"),
        direction(change(v, o)).alias("back_direction"))


# --- loads ------------------------------------------------------------------------

_PLAIN_EVENT = ("event_key", "date_key", "customer_key", "channel_key", "stage")


def csv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = fresh_folder(spark, "raw")
    write_csv(event_star(spark, root).fact_funnel_event, path, FUNNEL)
    good, bad = load_table(spark, path, FUNNEL)
    return good.unionByName(bad.withColumn("event_ts", F.lit(None).cast("timestamp"))).select(
        *_PLAIN_EVENT, moment("event_ts").alias("event_ts"))


def order_line_totals(star: Star) -> DataFrame:
    """All that the order fact holds, against the lines it is made of."""
    return star.fact_orders.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("revenue"),
        F.sum("quantity").alias("units"), F.count_distinct("product_key").alias("products"))


def compare_requests(spark: SparkSession, root: str) -> DataFrame:
    """Each order month against the month a year before, which the first year does not have."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    asked = read_source(spark, root, "orders").select(month.alias("m")).distinct().select(
        F.date_format("m", "yyyy-MM").alias("request"), F.concat_ws("-", F.year("m"), F.month("m")).alias("current"),
        F.date_format(F.add_months("m", -12), "yyyy-MM").alias("previous"))
    return periods.compare_requests(the_star(spark, root), asked, "revenue", "month").drop("provenance")


def ts_normalise(spark: SparkSession, root: str) -> DataFrame:
    """Event times written in four ways, one of them no time at all."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    text = (F.when(n == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(n == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
            .when(n == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
            .when(F.col("event_id") % 8 == 3, "n/a").otherwise(F.date_format(ts, "HH:mm")))
    raw = read_source(spark, root, "events").select(
        F.col("event_id").alias("event_key"), text.alias("event_ts"))
    good, bad = normalise_times(raw, FUNNEL)
    return good.select("event_key", moment("event_ts").alias("event_ts"),
                       F.lit("parsed").alias("status")).unionByName(
        bad.select("event_key", F.lit(None).cast("timestamp_ntz").alias("event_ts"),
                   F.lit("rejected").alias("status")))


def dim_load(ledger: Ledger) -> DataFrame:
    labels = {"dim_date": F.col("date").cast("string"), "dim_customer": F.col("segment"),
              "dim_channel": F.col("channel_name"), "dim_product": F.col("product_name")}
    frames = [ledger.read(t).select(F.lit(t).alias("table_name"),
                                    F.col(t.removeprefix("dim_") + "_key").cast("long").alias("key"),
                                    labels[t].alias("label")) for t in DIMENSIONS]
    return reduce(DataFrame.unionByName, frames)


def fact_load_by_month(spark: SparkSession, root: str) -> DataFrame:
    ledger = Ledger(spark, fresh_folder(spark, "monthly"))
    ledger.load_by_month(ORDERS, the_star(spark, root).fact_orders)
    return ledger.log(ORDERS).select(
        "snapshot_id", F.col("batch").alias("month"), "operation", "added_records",
        "total_records")


def load_counts(ledger: Ledger) -> DataFrame:
    frames = [ledger.read(t).agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(t).alias("table_name"), "row_count") for t in FACT_TIME]
    return frames[0].unionByName(frames[1])


def events_at(snapshot_id: int | None) -> Query:
    return on_ledger(lambda ledger: ledger.read(FUNNEL, snapshot_id)
                     .select(*_PLAIN_EVENT, moment("event_ts").alias("event_ts")))


def append_batch(ledger: Ledger) -> DataFrame:
    """What the newest commit of each fact added."""
    frames = []
    for table in FACT_TIME:
        timeline = ledger.timeline(table)
        added = (ledger.read(table, with_commit=True, timeline=timeline)
                 .filter(F.col("commit_id") == timeline.at().snapshot_id))
        frames.append(added.groupBy("channel_key").agg(F.count(F.lit(1)).alias("added"))
                      .select(F.lit(table).alias("table_name"), "channel_key", "added"))
    return frames[0].unionByName(frames[1])


def append_stream(spark: SparkSession, root: str) -> DataFrame:
    """Raw files appended by a stream that is started twice: rows stored, and rows without a readable time."""
    source = event_star(spark, root).fact_funnel_event
    base = fresh_folder(spark, "stream")
    unread = source.withColumn("event_ts", F.when(F.col("event_key") % 50 != 7, F.col("event_ts")))
    write_csv(unread.repartitionByRange(4, "event_key"), f"{base}/raw", FUNNEL)
    ledger = Ledger(spark, f"{base}/tables")
    for _ in range(2):
        append_files(ledger, FUNNEL, f"{base}/raw", f"{base}/checkpoint", "raw", f"{base}/rejects",
                     max_files=2).awaitTermination()
    stored = ledger.read(FUNNEL).select(F.lit("stored").alias("status"), F.to_date("event_ts").alias("day"), "stage")
    refused = spark.read.parquet(f"{base}/rejects").select(F.lit("rejected").alias("status"), F.lit(None).cast("date").alias("day"), "stage")
    return stored.unionByName(refused).groupBy("status", "day", "stage").agg(F.count(F.lit(1)).alias("events"))


def serve_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = fresh_folder(spark, "served")
    serve_files(the_star(spark, root), path)
    return vw_funnel_weekly(served_files(spark, path))


def published_views(spark: SparkSession, root: str) -> DataFrame:
    publish_views(the_star(spark, root))
    return spark.sql("""
        SELECT t.iso_year, t.iso_week, t.stage, t.events, t.yoy_pct, o.revenue, o.revenue_yoy_pct
        FROM vw_funnel_stage_trend t JOIN vw_orders_trend o USING (iso_year, iso_week)
        WHERE t.is_complete_week""")


# --- versions -----------------------------------------------------------------------

def current_snapshot(ledger: Ledger) -> DataFrame:
    newest = F.max_by(F.struct("snapshot_id", "committed_at", "operation", "total_records"),
                      F.struct("committed_at", "snapshot_id"))
    return (ledger.log().groupBy("table_name").agg(newest.alias("s"))
            .select("table_name", "s.snapshot_id", moment("s.committed_at").alias("committed_at"),
                    "s.operation", "s.total_records"))


def as_of_resolve(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot live 31 days after each event, asked by time, by bare date, far ahead and in no known way."""
    ledger = published(spark, root)
    later = F.col("ts").cast("timestamp") + F.expr("interval 31 days")
    events = read_source(spark, root, "events")
    asked = events.select(
        "event_id", F.when(F.col("event_id") % 10 == 9, F.date_format(later, "HH:mm"))
        .when(F.col("event_id") % 10 == 8, F.lit("9999-12-31")).when(F.col("event_id") % 10 == 7, F.date_format(later, "yyyy-MM"))
        .when(F.col("event_id") % 10 == 6, F.date_format(later, "yyyyMMdd"))
        .when(F.col("event_id") % 10 == 5, F.concat(F.date_format(later, "yyyy-MM-dd HH:mm"), F.lit("Z")))
        .when(F.col("event_id") % 2 == 0, F.date_format(later, "yyyy-MM-dd"))
        .otherwise(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss")).alias("as_of"))
    return ledger.resolve_moments(FUNNEL, asked).select("event_id", "as_of", "snapshot_id", "note")


def snapshot_history(ledger: Ledger) -> DataFrame:
    return history.snapshot_history(ledger).withColumn(
        "snapshot_committed_at", moment("snapshot_committed_at"))


def compare_as_of(as_of: str, stage: str) -> Query:
    return on_ledger(lambda ledger: history.compare_as_of(ledger, as_of, stage)
                     .withColumn("historical_committed_at", moment("historical_committed_at"))
                     .withColumn("current_committed_at", moment("current_committed_at")))


RANGES = {
    "one week": (dt.datetime(2024, 1, 8, tzinfo=UTC), dt.datetime(2024, 1, 15, tzinfo=UTC)),
    "inside days": (dt.datetime(2024, 1, 15, 12, tzinfo=UTC), dt.datetime(2024, 1, 20, 6, tzinfo=UTC)),
    "everything": (dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 2, 1, tzinfo=UTC)),
    "nothing": (dt.datetime(2023, 5, 1, tzinfo=UTC), dt.datetime(2023, 6, 1, tzinfo=UTC)),
}


def cross_spec_read(ledger: Ledger) -> DataFrame:
    frames = [ledger.time_range(FUNNEL, *span).groupBy("stage")
              .agg(F.count(F.lit(1)).alias("events"))
              .select(F.lit(name).alias("time_range"), "stage", "events")
              for name, span in RANGES.items()]
    return reduce(DataFrame.unionByName, frames)


# --- the registry -------------------------------------------------------------------

FIVE = ("visit", "lead", "opportunity", "orders", "revenue")


def all_queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "dim_date": on_star(lambda s: s.dim_date),
        "dim_date_extend": dim_date_extend,
        "period_labels": on_star(period_labels),
        "latest_complete_week": latest_week("calendar"),
        "latest_complete_week_fact": latest_week("fact"),
        "resolve_week": resolve_week,
        "week_containing": week_containing,
        "normalise_period": normalised,
        "pct_helpers": on_star(pct_helpers),
    }
    named.update({name: on_star(build) for name, build in VIEWS.items()})
    named["published_views"] = published_views
    named.update({name: on_star(build) for name, build in catalogue().items()})
    named["catalogue_smoke"] = on_star(run_catalogue)

    named["funnel_yoy"] = on_star(funnel.funnel_yoy_all)
    named["funnel_yoy_week"] = on_star(lambda s: funnel.funnel_yoy(s, "lead"))
    named["funnel_snapshot"] = on_star(funnel.funnel_snapshot_all)
    named["funnel_snapshot_week"] = on_star(lambda s: funnel.funnel_snapshot(s))
    named["funnel_anomalies"] = on_star(funnel.funnel_anomalies)
    named["funnel_anomalies_sensitive"] = on_star(lambda s: funnel.funnel_anomalies(s, 0.1))
    named["funnel_anomalies_weeks"] = on_star(funnel.funnel_anomalies_all)
    for m in FIVE:
        named[f"weekly_trend_{m}"] = on_star(lambda s, m=m: trends.weekly_trend(s, m, 12))
    named["weekly_trend_weeks"] = on_star(lambda s: trends.weekly_trend_all(s, "revenue"))
    for p in ("wtd", "mtd", "ytd"):
        named[f"running_total_{p}"] = on_star(lambda s, p=p: trends.running_total(s, "orders", p))
    named["running_total_year"] = on_star(lambda s: trends.running_total(s, "lead", "wtd", 1998))
    named["running_total_multi"] = on_star(lambda s: trends.running_total(s, FIVE, "mtd"))
    named["running_total_latest"] = on_star(lambda s: trends.running_total_latest(s, FIVE, "ytd"))
    named["running_total_days"] = on_star(lambda s: trends.running_total_all(s, FIVE, "ytd"))
    for d, m in (("channel", "orders"), ("product", "revenue"), ("region", "avg_deal_size"),
                 ("segment", "revenue")):
        named[f"top_{d}"] = on_star(lambda s, d=d, m=m: rank.top_dimension(s, d, m))
        named[f"top_{d}_weeks"] = on_star(lambda s, d=d, m=m: rank.top_dimension_all(s, d, m, 3))
    for g in GRAINS:
        named[f"period_compare_{g}"] = on_star(
            lambda s, g=g: periods.period_compare(s, "revenue", g))
        named[f"period_changes_{g}"] = on_star(
            lambda s, g=g: periods.period_changes(s, "avg_deal_size" if g == "month" else "lead", g))
    named["period_compare_named"] = on_star(
        lambda s: periods.period_compare(s, "orders", "quarter", "q1 1998", "1997-Q1"))
    named["period_compare_preceding"] = on_star(
        lambda s: periods.period_compare(s, "visit", "week", "1999-w1"))
    named["period_changes_strict"] = on_star(
        lambda s: periods.period_changes(s, "orders", "month", strict=True))
    named["daily_trend"] = on_star(lambda s: trends.daily_trend(s, "lead", 30))
    named["daily_trend_dense"] = on_star(lambda s: trends.daily_trend(s, "orders", 30, dense=True))
    named["daily_trend_summary"] = on_star(lambda s: trends.daily_trend_summary(s, "revenue", 30))

    named["period_compare_requests"] = compare_requests
    named["order_line_totals"] = on_star(order_line_totals)
    for d in (30, 400):
        named[f"running_total_newest_{d}"] = on_star(lambda s, d=d: trends.running_total(s, FIVE, "mtd", days=d))

    named["csv_roundtrip"] = csv_roundtrip
    named["ts_normalise"] = ts_normalise
    named["dim_load"] = on_ledger(dim_load)
    named["fact_load_by_month"] = fact_load_by_month
    named["load_counts"] = on_ledger(load_counts)
    named["evolved_read"] = events_at(None)
    named["append_batch"] = on_ledger(append_batch)
    named["append_stream"] = append_stream
    named["serve_roundtrip"] = serve_roundtrip

    named["current_snapshot"] = on_ledger(current_snapshot)
    named["as_of_resolve"] = as_of_resolve
    named["read_snapshot"] = events_at(3)
    named["snapshot_history"] = on_ledger(snapshot_history)
    named["compare_as_of"] = compare_as_of("2024-02-01", "lead")
    named["compare_as_of_moment"] = compare_as_of("2024-02-01T06:00:00Z", "visit")
    named["cross_spec_read"] = on_ledger(cross_spec_read)

    named["stored_funnel_weekly"] = on_ledger(lambda ledger: vw_funnel_weekly(ledger.star()))
    named["stored_funnel_weekly_as_of"] = on_ledger(
        lambda ledger: vw_funnel_weekly(ledger.star("2024-02-02")))
    named["stored_funnel_snapshot"] = on_ledger(
        lambda ledger: funnel.funnel_snapshot(ledger.star()))

    named["iso_week_span"] = on_star(checks.iso_week_span)
    named["yoy_pair_check"] = on_star(checks.yoy_pair_check)
    named["rate_null_check"] = on_star(checks.rate_null_check)
    named["contract_check"] = on_star(checks.contract_check)

    return named
