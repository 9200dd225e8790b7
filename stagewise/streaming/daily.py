"""Events per day and stage, kept by a stream.

Raw rows are added up inside each task before the state is asked, so a day or stage that holds a
third of all rows is one row per task.  The state has one count per day and stage and is never
rebuilt from the facts.  A watermark follows the newest event time; a day that lies behind it as a
whole is closed: rows for it are no longer counted, but reported as late with their number, and rows
that can not be read at all are reported with the same frame.  Nothing vanishes.

The watermark of a trigger is the one of the triggers before it, so rows that arrive together
are all counted whatever order they are in.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stagewise.streaming.files import keep_batch, read_folder, start_folder, stream_rows

FUNNEL = "fact_funnel_event"
COUNTS = T.StructType([T.StructField("day", T.DateType()), T.StructField("stage", T.StringType()),
                       T.StructField("events", T.LongType()), T.StructField("late", T.LongType()),
                       T.StructField("unreadable", T.LongType())])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per day and stage of a task, with the newest event time of the day."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).group_by(["day", "stage", "readable"]).aggregate(
            [("events", "sum"), ("event_ts", "max")]).rename_columns(["day", "stage", "readable", "events", "event_ts"]))
    if held:
        total = pa.concat_tables(held).group_by(["day", "stage", "readable"]).aggregate(
            [("events", "sum"), ("event_ts", "max")]).rename_columns(["day", "stage", "readable", "events", "event_ts"])
        yield from total.select(["day", "stage", "readable", "events", "event_ts"]).combine_chunks().to_batches()


def _count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    day, stage, readable = key
    total = int(sum(int(p["events"].sum()) for p in parts))
    counted, late, unreadable = state.get if state.exists else (0, 0, 0)
    if not readable:
        unreadable += total
    elif dt.datetime.combine(day, dt.time.min, dt.timezone.utc).timestamp() * 1000 + 86_400_000 <= state.getCurrentWatermarkMs():
        late += total
    else:
        counted += total
    state.update((counted, late, unreadable))
    yield pd.DataFrame({"day": [day], "stage": [stage], "events": [counted], "late": [late], "unreadable": [unreadable]})


def stream_daily(spark: SparkSession, source: str, root: str, delay: str = "10 days",
                 max_files: int | None = None) -> StreamingQuery:
    """Count the files of a folder that were not counted yet, then stop; ``root`` holds counts and state."""
    start_folder(spark, f"{root}/counts", COUNTS)
    rows = stream_rows(spark, FUNNEL, source, max_files)
    good = F.size("reasons") == 0
    plain = rows.select(F.when(good, F.to_date("event_ts")).alias("day"), F.when(good, F.col("stage")).alias("stage"),
                        good.alias("readable"), F.lit(1).cast("long").alias("events"),
                        F.when(good, F.col("event_ts")).alias("event_ts"))
    added = plain.mapInArrow(_add_up, "day date, stage string, readable boolean, events long, event_ts timestamp")
    counts = (added.withWatermark("event_ts", delay).groupBy("day", "stage", "readable")
              .applyInPandasWithState(_count, COUNTS, "events long, late long, unreadable long", "update",
                                      GroupStateTimeout.NoTimeout))
    return (counts.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
            .foreachBatch(keep_batch(f"{root}/counts")).trigger(availableNow=True).start())


def _newest(spark: SparkSession, root: str) -> DataFrame:
    """Each count as the last trigger that touched it left it."""
    return (read_folder(spark, f"{root}/counts", COUNTS).groupBy("day", "stage")
            .agg(*[F.max(c).alias(c) for c in ("events", "late", "unreadable")]))  # counts only grow


def daily_counts(spark: SparkSession, root: str) -> DataFrame:
    return _newest(spark, root).filter("events > 0").select("day", "stage", "events")


def refused_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows that are in no count: those behind the watermark by day and stage, and the unreadable ones."""
    rows = _newest(spark, root)
    return (rows.filter("late > 0").select(F.lit("late").alias("reason"), "day", "stage", F.col("late").alias("events"))
            .unionByName(rows.filter("unreadable > 0").select(F.lit("unreadable").alias("reason"), "day", "stage",
                                                              F.col("unreadable").alias("events"))))
