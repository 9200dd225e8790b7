"""The as-of join by sort and carry, and time travel in bulk on it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stagewise.operators import history
from stagewise.operators.asof import as_of_join
from stagewise.sources.ledger import Ledger
from tests.test_ledger import FUNNEL, at, events

UTC = dt.timezone.utc
START = dt.datetime(2026, 1, 1, tzinfo=UTC)


def moments(spark, rows):
    return spark.createDataFrame([(i, k, None if s is None else START + dt.timedelta(seconds=s)) for i, k, s in rows], "id long, k string, at timestamp")


def changes(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(seconds=s), v) for k, s, v in rows], "k string, since timestamp, v long")


def brute(asked, held, keyed):
    out = {}
    for i, k, s in asked:
        known = [(c, v) for kk, c, v in held if s is not None and c <= s and (not keyed or kk == k)]
        out[i] = max(known)[1] if known else None
    return out


@pytest.mark.parametrize("slices", [1, 2, 7, None])
@pytest.mark.parametrize("keyed", [False, True])
def test_against_every_pair(spark, slices, keyed):
    r = random.Random(5)
    asked = [(i, r.choice(["a", "b", None]) if not keyed else r.choice("abc"), r.choice([None, r.randrange(500)])) for i in range(400)]
    held = [(r.choice("ab"), 100 + r.randrange(300) // 7, n) for n in range(60)]
    got = as_of_join(moments(spark, asked), changes(spark, held), "at", "since", ["v"], tie="v", by=["k"] if keyed else [], slices=slices)
    assert {x.id: x.v for x in got.collect()} == brute(asked, held, keyed) and got.columns == ["id", "k", "at", "v"]


def test_null_keys_meet_null_keys(spark):
    got = as_of_join(moments(spark, [(1, None, 5), (2, "a", 5)]), changes(spark, [(None, 1, 9)]), "at", "since", ["v"], tie="v", by=["k"])
    assert {x.id: x.v for x in got.collect()} == {1: 9, 2: None}


def test_empty_sides(spark):
    some = moments(spark, [(1, "a", 5)])
    assert as_of_join(some, changes(spark, []), "at", "since", ["v"], tie="v").first().v is None
    assert as_of_join(some.limit(0), changes(spark, [("a", 1, 1)]), "at", "since", ["v"], tie="v").collect() == []


def made(frame):
    """Rows out of every join of the plan that ran."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    out, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_work_is_linear_in_moments_and_changes_of_one_day(spark):
    """Two thousand changes and five thousand moments of one day: no join gives more rows than were asked."""
    asked = spark.range(5000).select("id", F.timestamp_micros(F.lit(10**15) + F.col("id") * 7_000_000).alias("at"))
    held = spark.range(2000).select(F.timestamp_micros(F.lit(10**15) + F.col("id") * 17_000_000).alias("since"), F.col("id").alias("v"))
    for slices in (1, 6):
        rows = made(as_of_join(asked, held, "at", "since", ["v"], tie="v", slices=slices))
        assert rows and max(rows) <= 5000


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Commits by the dozen on one day, and one that replaces the table."""
    held = Ledger(spark, str(tmp_path_factory.mktemp("busy")))
    for n in range(6):
        held.append(FUNNEL, events(spark, (n, ("lead", "visit")[n % 2], "2026-01-05T08:00:00")), at(f"2026-02-01T06:0{n}:00"))
    held.overwrite(FUNNEL, events(spark, (50, "lead", "2026-01-05T08:00:00")), at("2026-02-01T07:00:00"))
    held.append(FUNNEL, events(spark, (51, "visit", "2026-01-06T08:00:00")), at("2026-02-02T06:00:00"))
    return held


def test_the_single_form_is_a_row_of_the_bulk_form(spark, busy):
    asked = ["2026-02-01T06:00:00", "2026-02-01T06:03:30", "2026-02-01T06:05:00Z", "2026-02-01T07:00:00", "2026-02-01", "2026-02-05"]
    got = history.compare_as_of_all(busy, spark.createDataFrame([(a,) for a in asked], "as_of string")).collect()
    bulk = {(r.as_of_requested, r.stage): r for r in got}
    assert len(bulk) == len(got) == 3 * len(asked)
    for a in asked:
        for stage in ("visit", "lead", "opportunity"):
            one, many = history.compare_as_of(busy, a, stage).first(), bulk[a, stage]
            for name in one.asDict():
                if name != "provenance":
                    assert one[name] == many[name], (a, stage, name)
            assert many.provenance.source_tables == [FUNNEL] and many.provenance.snapshot_id == one.provenance.snapshot_id


def test_texts_that_are_no_moment_keep_a_row(spark, busy):
    asked = spark.createDataFrame([("soon",), ("2026-01-31",), ("2026-01-31",)], "as_of string")
    got = {r.as_of_requested: (r.stage, r.historical_events, r.note) for r in history.compare_as_of_all(busy, asked).collect()}
    assert got == {"soon": (None, None, "neither a date nor an ISO time"), "2026-01-31": (None, None, "before the first commit")}


def test_the_fact_is_read_once(spark, busy):
    asked = spark.createDataFrame([("2026-02-01",)], "as_of string")
    plan = history.compare_as_of_all(busy, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("stage#" in line and "Relation" in line for line in plan.splitlines()) == 1
