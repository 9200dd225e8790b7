"""Column names and types of the star schema, used instead of inference.

Keys of customers and products are long: a dimension that grows with the data
can outgrow an int.  ``revenue`` stays double in storage and is summed as
``MONEY`` so that totals do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

STAGES = ("visit", "lead", "opportunity")


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in columns.items()])


DIM_DATE = _schema(
    date_key=T.IntegerType(), date=T.DateType(), year=T.IntegerType(),
    quarter=T.IntegerType(), month=T.IntegerType(), month_name=T.StringType(),
    iso_year=T.IntegerType(), iso_week=T.IntegerType(),
    week_start_date=T.DateType(), day_of_week=T.StringType())

DIM_CUSTOMER = _schema(
    customer_key=T.LongType(), customer_id=T.StringType(), name=T.StringType(),
    segment=T.StringType(), region=T.StringType(), signup_date=T.DateType())

DIM_CHANNEL = _schema(
    channel_key=T.IntegerType(), channel_name=T.StringType(), channel_group=T.StringType())

DIM_PRODUCT = _schema(
    product_key=T.LongType(), product_name=T.StringType(),
    category=T.StringType(), unit_price=T.DoubleType())

FACT_FUNNEL_EVENT = _schema(
    event_key=T.LongType(), date_key=T.IntegerType(), customer_key=T.LongType(),
    channel_key=T.IntegerType(), stage=T.StringType(), event_ts=T.TimestampType())

FACT_ORDERS = _schema(
    order_line_key=T.LongType(), date_key=T.IntegerType(), customer_key=T.LongType(),
    channel_key=T.IntegerType(), product_key=T.LongType(), revenue=T.DoubleType(),
    quantity=T.IntegerType(), order_ts=T.TimestampType())

TABLES = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_channel": DIM_CHANNEL,
    "dim_product": DIM_PRODUCT,
    "fact_funnel_event": FACT_FUNNEL_EVENT,
    "fact_orders": FACT_ORDERS,
}

DIMENSIONS = ("dim_date", "dim_customer", "dim_channel", "dim_product")
FACT_TIME = {"fact_funnel_event": "event_ts", "fact_orders": "order_ts"}

# child table, key column, parent table
FOREIGN_KEYS = (
    ("fact_funnel_event", "date_key", "dim_date"),
    ("fact_funnel_event", "customer_key", "dim_customer"),
    ("fact_funnel_event", "channel_key", "dim_channel"),
    ("fact_orders", "date_key", "dim_date"),
    ("fact_orders", "customer_key", "dim_customer"),
    ("fact_orders", "channel_key", "dim_channel"),
    ("fact_orders", "product_key", "dim_product"),
)


def raw_schema(table: str) -> T.StructType:
    """The schema of the raw text file: fact times stay text until parsed."""
    ts = FACT_TIME.get(table)
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == ts else f.dataType, f.nullable)
        for f in TABLES[table]])
