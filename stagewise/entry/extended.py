"""Registered queries on deliveries, stored layouts, bulk answers and copies, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.entry.oracle import EVENT_ROWS, EVENTS, EVERY_PAIR, PARENTS, SNAPSHOTS, compared, metrics, rounded, star_with
from stagewise.entry.oracle import change as change_sql
from stagewise.entry.oracle import star as star_sql
from stagewise.entry.published import fresh_folder, published
from stagewise.functions.calendar import GRAINS
from stagewise.operators import funnel, periods, rank, trends
from stagewise.operators.asof import as_of_join
from stagewise.operators.fingerprint import differing_keys, fingerprint
from stagewise.operators.history import compare_as_of, compare_as_of_all
from stagewise.operators.leaders import top_product_periods
from stagewise.operators.periods import period_changes_all
from stagewise.operators.suspects import fk_suspects_all
from stagewise.schemas import MONEY, TABLES
from stagewise.session import use_utc
from stagewise.sources.bindings import event_star, orders_star, read_source
from stagewise.sources.buckets import buckets_for, store_bucketed
from stagewise.sources.checked import check_rows, read_text
from stagewise.sources.raw import write_csv
from stagewise.sources.serve import serve_files_watched, served_files
from stagewise.star import Star
from stagewise.streaming.daily import daily_counts, refused_counts, stream_daily
from stagewise.streaming.unique import stream_unique, unique_events

Query = Callable[[SparkSession, str], DataFrame]
FUNNEL, ORDERS = "fact_funnel_event", "fact_orders"

# --- deliveries -------------------------------------------------------------------

def csv_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Raw lines of which six in forty are broken, each in another way."""
    rows = event_star(spark, root).fact_funnel_event
    k = F.col("event_key") % 40
    line = F.concat_ws(
        ",", F.when(k == 0, F.concat(F.lit("x"), "event_key")).otherwise(F.col("event_key").cast("string")),
        F.when(k == 5, "3.5").otherwise(F.col("date_key").cast("string")),
        F.when(k == 4, "twelve").otherwise(F.col("customer_key").cast("string")), F.col("channel_key").cast("string"),
        F.when(k == 1, F.lit(None)).when(k == 5, "").otherwise(F.col("stage")),
        F.when(k == 1, F.lit(None)).when(k == 3, "n/a").otherwise(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), F.when(k == 2, F.lit("more,and more")))
    path = fresh_folder(spark, "broken")
    rows.select(line.alias("value")).write.text(path)
    checked = check_rows(read_text(spark, path, FUNNEL, header=False), FUNNEL)
    good = F.size("reasons") == 0
    return checked.select(F.col("raw.event_key").alias("raw_key"), F.when(good, "good").otherwise("rejected").alias("status"),
                          F.concat_ws("; ", "reasons").alias("reasons"), F.when(good, F.col("stage")).alias("stage"),
                          F.when(good, F.col("event_ts").cast("timestamp_ntz")).alias("event_ts"))


CSV_REJECTS = f"""{EVENTS}, r AS ({EVENT_ROWS}), k AS (SELECT *, event_key % 40 AS k FROM r)
    SELECT CASE k WHEN 0 THEN 'x' ELSE '' END || event_key AS raw_key, CASE WHEN k < 6 THEN 'rejected' ELSE 'good' END AS status,
           CASE k WHEN 0 THEN 'event_key is not a whole number' WHEN 1 THEN 'columns are missing: 4 of 6'
                  WHEN 2 THEN 'columns too many: 8 for 6' WHEN 3 THEN 'event_ts is not a time'
                  WHEN 4 THEN 'customer_key is not a whole number' WHEN 5 THEN 'date_key is not a whole number; stage is missing'
                  ELSE '' END AS reasons,
           CASE WHEN k >= 6 THEN stage END AS stage, CASE WHEN k >= 6 THEN event_ts END AS event_ts FROM k"""


def _ten_days(rows: DataFrame) -> int:
    """How many spans of ten days the rows cover."""
    return (rows.agg(F.max("date_key")).first()[0] or 0) // 10 + 1


def _deliver(rows: DataFrame, base: str, name: str) -> None:
    write_csv(rows.repartition(3), f"{base}/raw/{name}", FUNNEL)


def stream_daily_stages(spark: SparkSession, root: str) -> DataFrame:
    """Files of ten days each, then rows of the first days long after: counted by a stream started twice."""
    rows = event_star(spark, root).fact_funnel_event
    base = fresh_folder(spark, "daily")
    late = (F.col("event_key") % 50 == 7) & (F.col("date_key") < 5)
    for span in range(_ten_days(rows)):
        _deliver(rows.filter(~late & (F.floor(F.col("date_key") / 10) == span)), base, f"{span:05d}")
    _deliver(rows.filter(late), base, "late")
    for _ in range(2):  # the second finds no new file
        stream_daily(spark, f"{base}/raw/*", f"{base}/kept", "10 days", max_files=3).awaitTermination()
    counted = daily_counts(spark, f"{base}/kept").select(F.lit("counted").alias("status"), "day", "stage", "events")
    return counted.unionByName(refused_counts(spark, f"{base}/kept").withColumnRenamed("reason", "status"))


STREAM_DAILY = f"""{EVENTS}
    SELECT CASE WHEN event_id % 50 = 7 AND date_key < 5 AND (SELECT max(date_key) FROM e) >= 16 THEN 'late' ELSE 'counted' END AS status,
           CAST(ts AS DATE) AS day, stage, count(*) AS events FROM e WHERE stage IS NOT NULL GROUP BY ALL"""


def stream_unique_events(spark: SparkSession, root: str) -> DataFrame:
    """Files that repeat keys inside themselves and from the days before them, delivered by key."""
    rows = event_star(spark, root).fact_funnel_event
    base = fresh_folder(spark, "unique")
    key, day = F.col("event_key"), F.col("date_key")
    for span in range(_ten_days(rows)):
        own = rows.filter(F.floor(day / 10) == span)
        again = rows.filter((key % 3 == 0) & day.between(10 * span - 3, 10 * span - 1))
        _deliver(own.unionByName(own.filter(key % 7 == 0)).unionByName(again), base, f"{span:05d}")
    for _ in range(2):
        stream_unique(spark, FUNNEL, f"{base}/raw/*", f"{base}/kept", "event_key", "14 days", max_files=3).awaitTermination()
    return unique_events(spark, FUNNEL, f"{base}/kept").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


# --- bulk time travel ---------------------------------------------------------------

def as_of_sorted(spark: SparkSession, root: str) -> DataFrame:
    """The sign-up before each purchase, of anyone and of the same user."""
    events = read_source(spark, root, "events")
    asked = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    changes = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"))
    found = as_of_join(asked, changes, "ts", "since", ["signup_id", "since"], tie="signup_id")
    own = as_of_join(found, changes.withColumnRenamed("signup_id", "own_signup_id"), "ts", "since", ["own_signup_id"],
                     tie="own_signup_id", by=["user_id"])
    return own.select("event_id", "signup_id", "since", "own_signup_id")


AS_OF_SORTED = """
    WITH s AS (SELECT ts, max(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY ts),
    u AS (SELECT user_id, ts, max(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
    SELECT p.event_id, s.id AS signup_id, s.ts AS since, u.id AS own_signup_id
    FROM events p ASOF LEFT JOIN s ON p.ts >= s.ts ASOF LEFT JOIN u ON p.user_id = u.user_id AND p.ts >= u.ts
    WHERE p.event_type = 'purchase'"""


def _asked_days(spark: SparkSession, root: str) -> DataFrame:
    """Every day of the events and the day 31 days on, each day asked in another spelling."""
    day = F.to_date("ts")
    days = read_source(spark, root, "events").select(F.explode(F.array(day, F.date_add(day, 31))).alias("day")).distinct()
    n = F.dayofmonth("day") % 3
    return days.select(F.when(n == 0, F.date_format("day", "yyyy-MM-dd")).when(n == 1, F.date_format("day", "yyyy-MM-dd'T'06:00:00"))
                       .otherwise(F.date_format("day", "yyyyMMdd")).alias("as_of"))


def compare_as_of_every(spark: SparkSession, root: str) -> DataFrame:
    found = compare_as_of_all(published(spark, root), _asked_days(spark, root)).drop("provenance")
    return found.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else c for c in found.columns])


COMPARE_AS_OF_ALL = f"""{EVENTS},
    d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events UNION SELECT DISTINCT CAST(ts AS DATE) + 31 FROM events),
    k AS (SELECT CASE day(day) % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y-%m-%dT06:00:00')
                 ELSE strftime(day, '%Y%m%d') END AS as_of,
                 CASE day(day) % 3 WHEN 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
                 WHEN 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR END AS cutoff FROM d),
    r AS (SELECT as_of, cutoff, max(snapshot_id) AS id, max(committed_at) AS live_at FROM k LEFT JOIN c ON committed_at <= cutoff GROUP BY ALL),
    g AS (SELECT stage, batch, count(*) AS n FROM e WHERE stage IS NOT NULL GROUP BY ALL),
    s(stage) AS (VALUES ('visit'), ('lead'), ('opportunity')),
    t AS (SELECT s.stage, c.snapshot_id, coalesce(sum(n), 0)::BIGINT AS n FROM s CROSS JOIN c LEFT JOIN g ON g.stage = s.stage AND g.batch < c.snapshot_id
          GROUP BY ALL)
    SELECT t.stage, as_of AS as_of_requested, t.n AS historical_events, id AS historical_snapshot_id, live_at AS historical_committed_at,
           w.n AS current_events, CASE WHEN id IS NOT NULL THEN 5 END AS current_snapshot_id,
           CASE WHEN id IS NOT NULL THEN TIMESTAMP '2024-02-04 06:00:00' END AS current_committed_at, w.n - t.n AS events_added_since,
           CASE WHEN cutoff IS NULL THEN 'neither a date nor an ISO time' WHEN id IS NULL THEN 'before the first commit' END AS note
    FROM r LEFT JOIN t ON t.snapshot_id = r.id LEFT JOIN t w ON w.snapshot_id = 5 AND w.stage = t.stage"""


# --- what answers say of themselves ---------------------------------------------------

def _cited(name: str, answer: DataFrame) -> DataFrame:
    """The sources and day ranges of an answer's rows; the moment it was computed is left out."""
    p, days = F.col("provenance"), F.col("provenance.date_range")
    lacks = p["calculation"].isNull() | p["as_of_date"].isNull() | (p["snapshot_committed_at"].isNull())
    return answer.groupBy(p["snapshot_id"].alias("snapshot_ids"), F.array_join(p["source_tables"], ", ").alias("source_tables")).agg(
        F.count_distinct(days["end"]).alias("day_ranges"), F.min(days["start"]).alias("first_day"), F.max(days["end"]).alias("last_day"),
        F.min(days["prior_start"]).alias("prior_first_day"), F.max(days["prior_end"]).alias("prior_last_day"),
        F.count_if(lacks).alias("incomplete")).withColumn("metric", F.lit(name))


def answers_provenance(spark: SparkSession, root: str) -> DataFrame:
    """One answer of each metric family over the stored tables, by what it cites."""
    ledger = published(spark, root)
    star = ledger.star()
    answers = {
        "funnel_yoy": funnel.funnel_yoy_all(star), "funnel_snapshot": funnel.funnel_snapshot_all(star),
        "weekly_trend": trends.weekly_trend_all(star, "revenue"), "top_dimension": rank.top_dimension_all(star, "channel", "orders"),
        "period_changes": periods.period_changes(star, "revenue", "week"), "daily_trend": trends.daily_trend_summary(star, "lead", 10),
        "compare_as_of": compare_as_of(ledger, "2024-02-01", "lead"),
        "compare_as_of_all": compare_as_of_all(ledger, spark.createDataFrame([("2024-02-01",), ("2024-02-02T06:00:00",)], "as_of string"))}
    return reduce(DataFrame.unionByName, [_cited(name, answer) for name, answer in answers.items()])


ANSWERS_PROVENANCE = f"""{EVENTS},
    wf AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w FROM e WHERE stage IS NOT NULL),
    wo AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w FROM e WHERE event_type = 'purchase'),
    wb AS (SELECT w FROM wf UNION SELECT w FROM wo),
    cw AS (SELECT min(date) AS a, max(date) AS b FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM first)
           GROUP BY date_trunc('week', date)),
    cp AS (SELECT a, b, lag(a) OVER (ORDER BY a) AS pa, lag(b) OVER (ORDER BY a) AS pb FROM cw),
    ld AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM e WHERE stage = 'lead' ORDER BY d DESC LIMIT 10),
    r(metric, snapshot_ids, source_tables, day_ranges, first_day, last_day, prior_first_day, prior_last_day) AS (
      SELECT 'funnel_yoy', '5', 'fact_funnel_event, dim_date', count(*), min(w), max(w) + 6, CAST(NULL AS DATE), CAST(NULL AS DATE) FROM wf
      UNION ALL SELECT 'funnel_snapshot', '5, 2', 'fact_funnel_event, fact_orders, dim_date', count(*), min(w), max(w) + 6, NULL, NULL FROM wb
      UNION ALL SELECT 'weekly_trend', '2', 'fact_orders, dim_date', count(*), min(w), max(w) + 6, NULL, NULL FROM wo
      UNION ALL SELECT 'top_dimension', '2', 'fact_orders, dim_date, dim_channel', count(*), min(w), max(w) + 6, NULL, NULL FROM wo
      UNION ALL SELECT 'period_changes', '2', 'fact_orders, dim_date', count(*), min(a), max(b), min(pa), max(pb) FROM cp WHERE pa IS NOT NULL
      UNION ALL SELECT 'daily_trend', '5', 'fact_funnel_event, dim_date', 1, min(d), max(d), NULL, NULL FROM ld
      UNION ALL SELECT 'compare_as_of', '5', 'fact_funnel_event', 1, NULL, DATE '2024-02-01', NULL, NULL
      UNION ALL SELECT 'compare_as_of_all', '5', 'fact_funnel_event', 2, NULL, DATE '2024-02-02', NULL, NULL)
    SELECT *, 0 AS incomplete FROM r"""


# --- all grains, stored layouts, filters, copies --------------------------------------

def _plain(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, root: build(orders_star(use_utc(spark), root)).drop("provenance")


def bucketed_order_lines(spark: SparkSession, root: str) -> DataFrame:
    """Finished orders and lines stored by order key, joined bucket by bucket."""
    orders, lines = bucketed_orders(spark, root)
    joined = lines.join(orders, "order_key")
    return joined.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("revenue"),
                      F.sum("quantity").alias("units"), F.count_distinct("product_key").alias("products"))


def bucketed_orders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = read_source(spark, root, "orders"), read_source(spark, root, "lineitem")
    many = buckets_for(lines.count())
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return (store_bucketed(orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_key"), "o_custkey", "o_orderdate"),
                           "orders", "order_key", many),
            store_bucketed(lines.select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("product_key"),
                                        net.cast(MONEY).cast("double").alias("revenue"), F.col("l_quantity").cast("int").alias("quantity")),
                           "lines", "order_key", many))


def fk_orphans(star: Star) -> DataFrame:
    """Keys of the facts against dimensions that lack every fiftieth customer and every seventieth product."""
    short = star.with_tables(dim_customer=star.dim_customer.filter("customer_key % 50 <> 7"),
                             dim_product=star.dim_product.filter("product_key % 70 <> 7"))
    return fk_suspects_all(short)


def _fk_sql() -> str:
    lost = {"customer": "customer_key % 50 = 7", "product": "product_key % 70 = 7"}
    return star_sql(" UNION ALL ".join(
        f"SELECT '{t}.{d}_key in dim_{d}' AS \"check\", count(*) AS rows_checked, count(*) FILTER ({lost.get(d, 'false')}) AS violations FROM {t}"
        for t, dims in PARENTS.items() for d in dims))


def serve_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """A serving copy against its source, and a changed copy with the keys that differ by kind."""
    star = orders_star(use_utc(spark), root)
    path = fresh_folder(spark, "copied")
    source = serve_files_watched(star, path)
    copy = served_files(spark, path)
    sides = [fingerprint(copy.table(t).select(*TABLES[t].fieldNames())).withColumn("table_name", F.lit(t)) for t in TABLES]
    alike = F.count_distinct("rows", "one", "two") == 1
    whole = (reduce(DataFrame.unionByName, sides, source).groupBy("table_name")
             .agg(F.when(alike, "same").otherwise("differs").alias("finding"), F.max("rows").alias("keys"))
             .withColumn("first_key", F.lit(None).cast("long")))
    key = F.col("customer_key")
    changed = (copy.dim_customer.filter(key % 100 != 1).withColumn("segment", F.when(key % 100 == 2, "MOVED").otherwise(F.col("segment")))
               .unionByName(copy.dim_customer.filter(key % 100 == 3)))
    columns = TABLES["dim_customer"].fieldNames()
    found = (differing_keys(star.dim_customer, changed, ["customer_key"], columns).groupBy("difference")
             .agg(F.count(F.lit(1)).alias("keys"), F.min("customer_key").alias("first_key"))
             .select(F.lit("dim_customer, changed").alias("table_name"), F.col("difference").alias("finding"), "keys", "first_key"))
    return whole.unionByName(found)


def _fingerprint_sql() -> str:
    rows = {"dim_date": "dim_date", "dim_customer": "customer", "dim_channel": "(SELECT DISTINCT o_orderpriority FROM orders)", "dim_product": "part",
            "fact_funnel_event": "fact_funnel_event", "fact_orders": "fact_orders"}
    whole = " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'same' AS finding, count(*) AS keys, CAST(NULL AS BIGINT) AS first_key FROM {f}"
                               for t, f in rows.items())
    kinds = {1: "only on the left", 2: "other values", 3: "another number of rows"}
    part = " UNION ALL ".join(f"SELECT 'dim_customer, changed', '{k}', count(*), min(c_custkey) FROM customer WHERE c_custkey % 100 = {m} HAVING count(*) > 0"
                              for m, k in kinds.items())
    return star_sql(f"{whole} UNION ALL {part}")


def _changes_sql() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({compared('orders', g, EVERY_PAIR)})" for g in GRAINS)


LEADERS = star_with("""
    p AS (SELECT f.product_key, f.revenue, d.iso_year, d.iso_week, d.date FROM fact_orders f JOIN dim_date d USING (date_key)),
    g AS (SELECT 'week' AS grain, printf('%d-W%02d', iso_year, iso_week) AS period, * FROM p
          UNION ALL SELECT 'month', strftime(date, '%Y-%m'), * FROM p
          UNION ALL SELECT 'quarter', printf('%d-Q%d', year(date), quarter(date)), * FROM p
          UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), * FROM p),
    s AS (SELECT grain, period, p_name AS name, sum(CAST(revenue AS DECIMAL(18,4))) AS amount FROM g JOIN part ON p_partkey = product_key GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY grain, period ORDER BY amount DESC, name) AS rank FROM s)""", f"""
    SELECT grain, period, CAST(rank AS INTEGER) AS rank, name, {rounded("amount", 2)} AS value FROM r WHERE rank <= 5""")


ANOMALY_REPORT = star_with(f"""{SNAPSHOTS.strip()},
    x AS (SELECT printf('%d-W%02d', c.iso_year, c.iso_week) AS current_week, c.kind, c.name,
                 CASE WHEN p.iso_year IS NOT NULL THEN printf('%d-W%02d', p.iso_year, p.iso_week) END AS previous_week,
                 {change_sql('c.value', 'p.value')} AS change_pct
          FROM figures c LEFT JOIN figures p ON p.kind = c.kind AND p.name = c.name AND p.week_start_date + 7 = c.week_start_date),
    w AS (SELECT current_week, max(previous_week) AS previous_week, count(*) FILTER (change_pct <= -20) AS fallen,
                 min({{'c': change_pct, 'k': kind, 'n': name}}) FILTER (change_pct <= -20) AS worst FROM x GROUP BY current_week)""", """
    SELECT current_week, previous_week, fallen, worst.n AS steepest, worst.c AS steepest_change_pct,
           CASE WHEN previous_week IS NULL THEN 'no events the week before, so nothing to set it against'
                WHEN fallen = 0 THEN 'no figure lost 20 % or more' END AS reason FROM w""")


QUERIES: dict[str, Query] = {
    "csv_rejects": csv_rejects,
    "stream_daily_stages": stream_daily_stages,
    "stream_unique_events": stream_unique_events,
    "as_of_sorted": as_of_sorted,
    "compare_as_of_all": compare_as_of_every,
    "answers_provenance": answers_provenance,
    "funnel_anomaly_report": _plain(funnel.funnel_anomaly_report),
    "period_changes_all": _plain(lambda star: period_changes_all(star, "orders")),
    "bucketed_order_lines": bucketed_order_lines,
    "top_product_periods": _plain(top_product_periods),
    "fk_suspects": _plain(fk_orphans),
    "serve_fingerprint": serve_fingerprint,
}

SQL: dict[str, str] = {
    "csv_rejects": CSV_REJECTS,
    "stream_daily_stages": STREAM_DAILY,
    "stream_unique_events": f"{EVENTS} {EVENT_ROWS}",
    "as_of_sorted": AS_OF_SORTED,
    "compare_as_of_all": COMPARE_AS_OF_ALL,
    "answers_provenance": ANSWERS_PROVENANCE,
    "funnel_anomaly_report": ANOMALY_REPORT,
    "period_changes_all": _changes_sql(),
    "bucketed_order_lines": metrics()["order_line_totals"],
    "top_product_periods": LEADERS,
    "fk_suspects": _fk_sql(),
    "serve_fingerprint": _fingerprint_sql(),
}
