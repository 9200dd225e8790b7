"""The versioned dataset that the time-travel queries read.

The click stream arrives in five batches, ``event_key % 5``, committed at fixed
moments.  Batches ignore event time, so an earlier snapshot is not a date
filter.  The first four are laid out by day, the last by month.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stagewise.session import workspace
from stagewise.sources.bindings import event_star
from stagewise.sources.ledger import Ledger
from stagewise.star import Star

UTC = dt.timezone.utc
COMMITS = (
    dt.datetime(2024, 2, 1, 6, tzinfo=UTC),
    dt.datetime(2024, 2, 1, 18, tzinfo=UTC),
    dt.datetime(2024, 2, 2, 6, tzinfo=UTC),
    dt.datetime(2024, 2, 3, 6, tzinfo=UTC),
    dt.datetime(2024, 2, 4, 6, tzinfo=UTC),
)

_held: dict[tuple[str, str], Ledger] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str) -> tuple[Ledger, Star]:
    """Write the dataset into the shared folder; ``(ledger, its source)``."""
    source = event_star(spark, root)
    ledger = Ledger(spark, fresh_folder(spark, "published"))
    ledger.load_dimensions(source, COMMITS[0])
    table, key = "fact_funnel_event", F.col("event_key")
    for batch, at in enumerate(COMMITS):
        if batch == len(COMMITS) - 1:
            ledger.evolve(table, "month")
        ledger.append(table, source.fact_funnel_event.filter(key % 5 == batch), at)
    line = F.col("order_line_key")
    ledger.append("fact_orders", source.fact_orders.filter(line % 5 < 4), COMMITS[0])
    ledger.append("fact_orders", source.fact_orders.filter(line % 5 == 4), COMMITS[-1])
    return ledger, source


def published(spark: SparkSession, root: str) -> Ledger:
    """The dataset of this session and folder, written on first use."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _held:
        _held[key] = publish(spark, root)[0]
    return _held[key]
