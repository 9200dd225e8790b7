"""All grains at once, bucketed facts, leaders from summaries, keys against bits, copies by fingerprint."""

import random
from collections import defaultdict
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import functions as F

from stagewise.entry import extended
from stagewise.functions.calendar import GRAINS
from stagewise.operators import checks, fingerprint, leaders, periods, suspects
from stagewise.schemas import TABLES
from stagewise.sources import bindings, serve
from stagewise.sources.buckets import buckets_for, store_bucketed
from tests.conftest import make_star


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    r = random.Random(2)
    days = [f"2026-{m:02d}-{d:02d}" for m in (1, 2, 3, 4) for d in (1, 2, 9, 16, 28)]
    orders = [(r.choice(days), r.randrange(1, 900) / 4, min(int(r.expovariate(0.35)), 11), r.randrange(3)) for _ in range(900)]
    return make_star(spark, "2025-12-29", "2026-05-03", events=[(d, "visit", 3) for d in days] + [(d, "lead", 1) for d in days[:7]], orders=orders)


# --- all grains ---------------------------------------------------------------

@pytest.mark.parametrize("measure", ["revenue", "avg_deal_size", "lead"])
@pytest.mark.parametrize("strict", [False, True])
def test_all_grains_are_the_four_questions(star, measure, strict):
    got = defaultdict(set)
    for r in periods.period_changes_all(star, measure, strict).drop("provenance").collect():
        got[r.grain].add(str(r))
    for grain in GRAINS:
        assert got[grain] == {str(r) for r in periods.period_changes(star, measure, grain, strict).drop("provenance").collect()}


def test_all_grains_read_the_fact_once(spark, tmp_path, star):
    star.fact_orders.write.parquet(str(tmp_path / "orders"))
    stored = star.with_tables(fact_orders=spark.read.parquet(str(tmp_path / "orders")))
    one = plan(periods.period_changes_all(stored, "revenue"))
    assert one.count("FileScan parquet") == 1 and "Expand" in one


# --- every week's answer ---------------------------------------------------------

def test_the_report_has_a_row_for_each_week_and_a_reason_for_each_empty_one(spark):
    from stagewise.operators import funnel

    days = [("2026-01-05", "visit", 100), ("2026-01-12", "visit", 60), ("2026-01-19", "visit", 59), ("2026-02-02", "visit", 10)]
    star = make_star(spark, "2026-01-05", "2026-02-08", events=days)
    got = {r.current_week: r for r in funnel.funnel_anomaly_report(star).collect()}
    assert {w: (r.fallen, r.steepest, r.steepest_change_pct) for w, r in got.items()} == {
        "2026-W02": (0, None, None), "2026-W03": (1, "visit", -40.0), "2026-W04": (0, None, None), "2026-W06": (0, None, None)}
    assert got["2026-W02"].reason == got["2026-W06"].reason == "no events the week before, so nothing to set it against"
    assert got["2026-W04"].reason == "no figure lost 20 % or more" and got["2026-W03"].reason is None
    listed = funnel.funnel_anomalies_all(star).collect()
    assert len(listed) == sum(r.fallen for r in got.values()) and str(got["2026-W03"].provenance.date_range.prior_start) == "2026-01-05"


# --- buckets --------------------------------------------------------------------

def test_a_join_of_bucketed_tables_moves_no_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store_bucketed(spark.range(3000).select((F.col("id") % 700).alias("k"), "id"), "left_rows", "k", 8)
        right = store_bucketed(spark.range(700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right_rows", "k", 8)
        joined = left.join(right, "k")
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert "Exchange" not in plan(joined.groupBy("k").agg(F.sum("v")))
        assert joined.agg(F.sum("v")).first()[0] == sum(2 * (i % 700) for i in range(3000))
        assert len(left.inputFiles()) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucket_numbers_divide_each_other():
    assert [buckets_for(n) for n in (0, 1, 10**7, 4 * 10**7, 10**10)] == [8, 8, 8, 16, 4096]


def test_a_table_name_is_checked(spark):
    with pytest.raises(ValueError, match="not a table name"):
        store_bucketed(spark.range(1), "a; drop", "id", 8)


# --- leaders ----------------------------------------------------------------------

def exact_leaders(star, measure, limit):
    days = leaders._periods(star)
    amount = F.count(F.lit(1)) if measure == "orders" else F.sum(F.col("revenue").cast("decimal(18,4)"))
    rows = (star.fact_orders.join(days, "date_key").join(star.dim_product, "product_key").groupBy("grain", "period", "product_name")
            .agg(amount.alias("a")).collect())
    by = defaultdict(list)
    for r in rows:
        by[r.grain, r.period].append((-Decimal(r.a), r.product_name))
    return {(g, p, i + 1): n for (g, p), held in by.items() for i, (_, n) in enumerate(sorted(held)[:limit])}


def products(spark, star, count):
    names = spark.createDataFrame([(i, f"id{i}", f"P{i:02d}" if i != 7 else "P03", "c", 1.0) for i in range(count)],
                                  "product_key long, product_id string, product_name string, category string, unit_price double")
    return star.with_tables(dim_product=names.drop("product_id"))


@pytest.mark.parametrize("measure", ["orders", "revenue"])
@pytest.mark.parametrize("capacity", [1, 2, 4, 8, 1000])
def test_leaders_are_exact_whatever_summaries_hold(spark, star, measure, capacity):
    whole = products(spark, star, 12)
    got = {(r.grain, r.period, r["rank"]): r.name for r in leaders.top_product_periods(whole, measure, 3, capacity).collect()}
    assert got == exact_leaders(whole, measure, 3)


def test_totals_lie_between_the_bounds_of_the_summaries(spark, star):
    whole = products(spark, star, 12)
    daily = leaders._daily(whole, "revenue")
    true = {r.product_key: r.t for r in daily.groupBy("product_key").agg(F.sum("amount").alias("t")).collect()}
    kept = leaders.day_summaries(daily, 3).collect()
    bounds = {r.date_key: r.bound for r in kept}
    least, own = defaultdict(Decimal), defaultdict(Decimal)
    for r in kept:
        least[r.product_key] += r.amount
        own[r.product_key] += r.bound
    for key, total in true.items():
        assert least[key] <= total <= least[key] + sum(bounds.values()) - own[key]
    assert max(sum(r.date_key == d for r in kept) for d in bounds) <= 3


def test_undecided_periods_are_those_where_an_unlisted_product_could_lead(spark):
    rows = spark.createDataFrame([(0, p, Decimal(a)) for p, a in ((1, 100), (2, 90), (3, 5))] + [(1, p, Decimal(a)) for p, a in ((1, 9), (2, 9), (3, 9))],
                                 "date_key int, product_key int, amount decimal(38,4)")
    days = spark.createDataFrame([(0, "day", "a"), (1, "day", "b"), (0, "both", "ab"), (1, "both", "ab")], "date_key int, grain string, period string")
    could, open_ = leaders.candidates(leaders.day_summaries(rows, 2), days, 1)
    assert {(r.grain, r.period) for r in open_.collect()} == {("day", "b")}
    assert sorted((r.period, r.product_key) for r in could.collect()) == [("a", 1), ("ab", 1)]


def test_a_negative_amount_takes_the_promise_away(spark):
    rows = spark.createDataFrame([(0, 1, Decimal(5)), (0, 2, Decimal(4)), (0, 3, Decimal(-3))], "date_key int, product_key int, amount decimal(38,4)")
    assert {r.bound for r in leaders.day_summaries(rows, 1).collect()} == {None}


# --- keys against bits ----------------------------------------------------------------

def keyed(spark, star):
    """Facts with orphans, null keys, negative keys and keys far outside."""
    r = random.Random(4)
    parents = sorted({r.randrange(-500, 4000) for _ in range(900)})
    dims = spark.createDataFrame([(p, f"c{p}", "n", "s", "r", None) for p in parents], "customer_key long, customer_id string, name string, segment string, region string, signup_date date")
    rows = [(i, 0, r.choice([r.choice(parents), r.randrange(-700, 5000), None, 10**12, -(10**12)]), 0, 0, 1.0, 1) for i in range(2000)]
    facts = spark.createDataFrame(rows, "order_line_key long, date_key int, customer_key long, channel_key int, product_key long, revenue double, quantity int").withColumn(
        "order_ts", F.current_timestamp())
    return star.with_tables(dim_customer=dims, fact_orders=facts)


@pytest.mark.parametrize("span", [suspects.SPAN, 4096, 512, 64])
def test_violations_are_those_of_the_join(spark, star, span):
    held = keyed(spark, star)
    want = {r.check: (r.rows_checked, r.violations) for r in checks.foreign_key_check(held, "fact_orders").collect()}
    got = {r.check: (r.rows_checked, r.violations) for r in suspects.fk_suspects(held, "fact_orders", span).collect()}
    assert got == want and want["fact_orders.customer_key in dim_customer"][1] > 300


def test_empty_parents_and_empty_facts(spark, star):
    none = star.with_tables(dim_customer=star.dim_customer.limit(0))
    assert {r.check: r.violations for r in suspects.fk_suspects(none, "fact_orders").collect()}["fact_orders.customer_key in dim_customer"] == 900
    empty = star.with_tables(fact_orders=star.fact_orders.limit(0))
    assert {(r.rows_checked, r.violations) for r in suspects.fk_suspects(empty, "fact_orders").collect()} == {(0, 0)}


def test_the_fact_is_read_once_and_no_parent_key_is_joined_to_it(spark, tmp_path, star):
    star.fact_orders.write.parquet(str(tmp_path / "orders"))
    stored = star.with_tables(fact_orders=spark.read.parquet(str(tmp_path / "orders")))
    frame = suspects.fk_suspects(stored, "fact_orders")
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parquet") == 1 and text.count("Join") == 1 + text.count("Join LeftOuter, (word")  # names only, and words among themselves


# --- copies -----------------------------------------------------------------------------

COPY = "k long, name string, x double"


def test_equal_tables_in_any_order(spark):
    rows = [(i % 40, f"n{i}", i / 3) for i in range(300)] + [(None, None, None)] * 2
    one, two = spark.createDataFrame(rows, COPY), spark.createDataFrame(rows[::-1], COPY).repartition(5)
    assert fingerprint.fingerprint(one).first() == fingerprint.fingerprint(two).first()
    assert fingerprint.differing_keys(one, two, ["k"]).collect() == []
    joined = fingerprint.unlike_ranges(fingerprint._hashed(one, ["k"], one.columns), fingerprint._hashed(two, ["k"], one.columns), 0)
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 2  # sums by range alone are shuffled


@pytest.mark.parametrize("few", [0, fingerprint.FEW])
def test_differing_keys_are_named(spark, monkeypatch, few):
    monkeypatch.setattr(fingerprint, "FEW", few)
    rows = [(i, f"n{i}", i / 3) for i in range(5000)]
    other = [r for r in rows if r[0] not in (10, 11)] + [(7, "n7", 7 / 3), (9999, "new", None), (None, "n", 1.0)]
    other = [(k, "moved" if k == 20 else n, None if k == 30 else x) for k, n, x in other]
    got = {r.k: (r.left_rows, r.right_rows, r.difference) for r in fingerprint.differing_keys(
        spark.createDataFrame(rows, COPY), spark.createDataFrame(other, COPY), ["k"]).collect()}
    assert got == {10: (1, 0, "only on the left"), 11: (1, 0, "only on the left"), 7: (1, 2, "another number of rows"), 20: (1, 1, "other values"),
                   30: (1, 1, "other values"), 9999: (0, 1, "only on the right"), None: (0, 1, "only on the right")}


def test_nulls_and_neighbours_are_told_apart(spark):
    prints = [fingerprint.fingerprint(spark.createDataFrame([row], "a string, b string")).first() for row in
              (("x", None), (None, "x"), ("x", ""), ("", "x"), ("", None), (None, None))]
    assert len(set(prints)) == 6


def test_named_keys_do_not_look_for_the_ranges_again(spark):
    rows = [(i, f"n{i}", i / 3) for i in range(5000)]
    found = fingerprint.differing_keys(spark.createDataFrame(rows, COPY), spark.createDataFrame(rows[1:], COPY), ["k"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # a side each, none by range


def _compared(source, copy):
    seen = {r.table_name: (r.rows, r.one, r.two) for r in source.collect()}
    return {t: seen[t] == tuple(fingerprint.fingerprint(copy.table(t).select(*TABLES[t].fieldNames())).first()) for t in TABLES}


def test_a_table_written_tells_its_fingerprint(spark, tmp_path, star):
    path = str(tmp_path / "copy")
    source = serve.serve_files_watched(star.with_tables(fact_funnel_event=star.fact_funnel_event.limit(0)), path)
    assert _compared(source, serve.served_files(spark, path)) == dict.fromkeys(TABLES, True)
    assert [tuple(r) for r in source.filter("table_name = 'fact_funnel_event'").collect()] == [("fact_funnel_event", 0, "0", "0")]
    star.dim_customer.limit(1).select(*TABLES["dim_customer"].fieldNames()).write.mode("append").parquet(f"{path}/dim_customer")
    assert _compared(source, serve.served_files(spark, path)) == dict.fromkeys(TABLES, True) | {"dim_customer": False}


def test_a_copy_is_compared_with_the_rows_that_were_written(spark, monkeypatch):
    """Lines that carry the time they were made at show that they are made once."""
    made = extended.orders_star
    monkeypatch.setattr(extended, "orders_star", lambda *a: (lambda s: s.with_tables(
        fact_orders=s.fact_orders.withColumn("order_ts", F.current_timestamp())))(made(*a)))
    found = {r.table_name: r.finding for r in extended.serve_fingerprint(spark, "/root/testdata/sf0.001").collect() if r.first_key is None}
    assert found == dict.fromkeys(TABLES, "same")


def _moved(frame) -> list[int]:
    """Rows each exchange of the plan of ``frame`` wrote, after running it."""
    query = frame._jdf.queryExecution()
    query.toRdd().count()
    found, todo = [], [query.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return sorted(found)


@pytest.mark.parametrize("span", [suspects.SPAN, 64])
def test_only_lines_of_finished_orders_are_moved(spark, monkeypatch, span):
    root, shared = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    plain = fingerprint.fingerprint(bindings.orders_star(spark, root).fact_orders).first()
    monkeypatch.setattr(bindings, "MANY_ORDERS", 0)
    monkeypatch.setattr(bindings, "key_filter", partial(suspects.key_filter, span=span))
    before = spark.conf.get(shared)
    spark.conf.set(shared, "-1")
    try:
        lines = bindings.orders_star(spark, root).fact_orders
        assert fingerprint.fingerprint(lines).first() == plain
        every = bindings.read_source(spark, root, "lineitem").count()
        assert _moved(lines)[-1] == plain.rows if span == suspects.SPAN else plain.rows <= _moved(lines)[-1] <= every
    finally:
        spark.conf.set(shared, before)
