"""The star schema over the warehouse tables this repository is tested with.

Two bindings.  ``orders_star`` reads orders as a nested funnel (every order is a
visit, accepted ones are leads, finished ones opportunities) with order lines as
the order fact.  ``event_star`` reads the click stream, which has a real time of
day; its purchases are the order fact.

The only job run here finds the first and the last day of the fact: date keys then need no join,
and the calendar is made of both without reading the fact again.  Where finished orders are too many
to be broadcast, one more finds the ends of their keys, when order lines are first asked for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.calendar import calendar
from stagewise.operators.suspects import key_filter
from stagewise.schemas import DIM_DATE, MONEY
from stagewise.session import use_utc
from stagewise.star import Star


# The columns read, stated so that no file is opened to infer them.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
}


def read_source(spark: SparkSession, root: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(SOURCE_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


#: Beyond so many finished orders, lines of others are told by bits before they are moved to the join.
MANY_ORDERS = 1_000_000


def _span(frame: DataFrame, column: str, *more: Column) -> tuple:
    """The first and the last day, and further aggregates of the same read."""
    return tuple(frame.agg(F.to_date(F.min(column)), F.to_date(F.max(column)), *more).first())


def _date_key(ts: Column, first: dt.date) -> Column:
    return F.datediff(F.to_date(ts), F.lit(first).cast("date"))


def _channel_key(priority: Column) -> Column:
    return F.substring(priority, 1, 1).cast("int") - 1


def _customers(spark: SparkSession, root: str) -> DataFrame:
    nation, region = read_source(spark, root, "nation"), read_source(spark, root, "region")
    place = (nation.join(region, nation.n_regionkey == region.r_regionkey)
             .select("n_nationkey", F.col("r_name").alias("region")))
    customer = read_source(spark, root, "customer")
    return (customer.join(place, customer.c_nationkey == place.n_nationkey)
            .select(F.col("c_custkey").alias("customer_key"),
                    F.col("c_name").alias("customer_id"),
                    F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("segment"),
                    "region",
                    F.lit(None).cast("date").alias("signup_date")))


def _channels(spark: SparkSession, root: str) -> DataFrame:
    name = F.col("o_orderpriority")
    return (read_source(spark, root, "orders").select(name).distinct()
            .select(_channel_key(name).alias("channel_key"),
                    name.alias("channel_name"),
                    F.when(F.substring(name, 1, 2).isin("1-", "2-"), "Paid")
                    .otherwise("Organic").alias("channel_group")))


def _products(spark: SparkSession, root: str) -> DataFrame:
    return read_source(spark, root, "part").select(
        F.col("p_partkey").alias("product_key"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"))


def _star(spark: SparkSession, root: str, span: tuple[dt.date | None, dt.date | None], narrow: dict | None = None,
          **facts: Callable[[], DataFrame]) -> Star:
    days = partial(calendar, spark, *span) if None not in span else partial(spark.createDataFrame, [], DIM_DATE)
    return Star(narrow=narrow, dim_date=days,
                dim_customer=partial(_customers, spark, root),
                dim_channel=partial(_channels, spark, root),
                dim_product=partial(_products, spark, root), **facts)


def _order_funnel(orders: DataFrame, first: dt.date) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    stages = (F.when(F.col("o_orderstatus") == "F",
                     F.array(F.lit("visit"), F.lit("lead"), F.lit("opportunity")))
              .when(F.col("o_orderstatus") == "P", F.array(F.lit("visit"), F.lit("lead")))
              .otherwise(F.array(F.lit("visit"))))
    return (orders.select("*", F.posexplode(stages).alias("ordinal", "stage"))
            .select((F.col("o_orderkey") * 3 + F.col("ordinal")).alias("event_key"),
                    _date_key(ts, first).alias("date_key"),
                    F.col("o_custkey").alias("customer_key"),
                    _channel_key(F.col("o_orderpriority")).alias("channel_key"),
                    "stage",
                    ts.alias("event_ts")))


def _order_lines(orders: DataFrame, lineitem: DataFrame, first: dt.date) -> DataFrame:
    """The lines of finished orders; the row is the grain.  ``order_line_key`` is a hash of
    the row that spreads rows over batches and identifies nothing.  No hint on the join: both
    sides grow with the data, so the engine picks the strategy and splits a hot order at run time."""
    ts = F.col("o_orderdate").cast("timestamp")
    won = orders.filter(F.col("o_orderstatus") == "F")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (lineitem.join(won, lineitem.l_orderkey == won.o_orderkey)
            .select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
                               "l_extendedprice", "l_quantity").alias("order_line_key"),
                    _date_key(ts, first).alias("date_key"),
                    F.col("o_custkey").alias("customer_key"),
                    _channel_key(F.col("o_orderpriority")).alias("channel_key"),
                    F.col("l_partkey").alias("product_key"),
                    F.round(net, 4).cast(MONEY).cast("double").alias("revenue"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                    ts.alias("order_ts")))


def orders_star(spark: SparkSession, root: str) -> Star:
    orders = read_source(spark, root, "orders")
    finished = F.col("o_orderstatus") == "F"
    first, last, won = _span(orders, "o_orderdate", F.count_if(finished))

    def lines(of: DataFrame) -> DataFrame:
        return _order_lines(of, read_source(spark, root, "lineitem"), first)

    def every_line() -> DataFrame:
        """Shared bits let lines of other orders pass; the join drops them."""
        lineitem = read_source(spark, root, "lineitem")
        if won > MANY_ORDERS:
            lineitem = lineitem.filter(~key_filter(orders.filter(finished), "o_orderkey").clear(F.col("l_orderkey")))
        return _order_lines(orders, lineitem, first)

    def on(keys: Collection[int]) -> DataFrame:
        """Orders of some days: a filter on the stored time, which the scan can use."""
        start = F.lit(dt.datetime.combine(first, dt.time.min)).cast("timestamp_ntz")
        ts = F.col("o_orderdate")
        if not keys:
            return orders.filter(F.lit(False))
        inside = (ts >= start + dt.timedelta(days=min(keys))) & (ts < start + dt.timedelta(days=max(keys) + 1))
        return orders.filter(inside & _date_key(ts, first).isin(*keys))

    return _star(spark, root, (first, last),
                 {"fact_funnel_event": lambda keys: _order_funnel(on(keys), first),
                  "fact_orders": lambda keys: lines(on(keys))},
                 fact_funnel_event=lambda: _order_funnel(orders, first),
                 fact_orders=every_line)


# event type -> funnel stage
EVENT_STAGES = {"view": "visit", "click": "lead", "signup": "opportunity"}


def _event_funnel(events: DataFrame, first: dt.date) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    stage = F.create_map(*[F.lit(x) for pair in EVENT_STAGES.items() for x in pair])
    return (events.filter(F.col("event_type").isin(*EVENT_STAGES))
            .select(F.col("event_id").alias("event_key"),
                    _date_key(ts, first).alias("date_key"),
                    F.col("user_id").alias("customer_key"),
                    F.pmod("event_id", F.lit(5)).cast("int").alias("channel_key"),
                    stage[F.col("event_type")].alias("stage"),
                    ts.alias("event_ts")))


def _event_purchases(events: DataFrame, first: dt.date) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return (events.filter(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("order_line_key"),
                    _date_key(ts, first).alias("date_key"),
                    F.col("user_id").alias("customer_key"),
                    F.pmod("event_id", F.lit(5)).cast("int").alias("channel_key"),
                    F.pmod("event_id", F.lit(97)).alias("product_key"),
                    F.col("value").alias("revenue"),
                    F.lit(1).alias("quantity"),
                    ts.alias("order_ts")))


def event_star(spark: SparkSession, root: str) -> Star:
    events = read_source(spark, root, "events")
    first, last = _span(events, "ts")
    return _star(spark, root, (first, last),
                 fact_funnel_event=lambda: _event_funnel(events, first),
                 fact_orders=lambda: _event_purchases(events, first))
