"""Events delivered once by key, however often their files repeat them.

The state holds a key until the watermark has passed its event time by the delay: repeats must
follow within the delay, which bounds the state by the events of that span rather than by all
events ever seen.  Delivery is exactly once: the state is part of the checkpoint, and a trigger
that runs again replaces its own folder.  A row that comes behind the watermark is not delivered;
how many there were is in the progress of the query (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stagewise.schemas import FACT_TIME, TABLES
from stagewise.streaming.files import keep_batch, read_folder, start_folder, stream_rows

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state on the executors' disks instead of in memory."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stored(table: str) -> T.StructType:
    """The columns delivered: nullable, as Parquet gives them back, and the reasons of a rejected row."""
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in TABLES[table].fields],
                         T.StructField("reasons", T.ArrayType(T.StringType()))])


def stream_unique(spark: SparkSession, table: str, source: str, root: str, key: str, delay: str = "4 days",
                  max_files: int | None = None) -> StreamingQuery:
    """Deliver the events of files not seen yet, each key once, then stop."""
    start_folder(spark, f"{root}/delivered", _stored(table))
    rows = stream_rows(spark, table, source, max_files).drop("raw")
    good = F.size("reasons") == 0
    once = rows.filter(good).withWatermark(FACT_TIME[table], delay).dropDuplicatesWithinWatermark([key])
    with disk_state(spark):
        return (once.unionByName(rows.filter(~good)).writeStream.outputMode("append")
                .option("checkpointLocation", f"{root}/state").foreachBatch(keep_batch(f"{root}/delivered"))
                .trigger(availableNow=True).start())


def unique_events(spark: SparkSession, table: str, root: str) -> DataFrame:
    return (read_folder(spark, f"{root}/delivered", _stored(table)).filter(F.size("reasons") == 0)
            .drop("batch", "reasons"))


def undelivered(spark: SparkSession, table: str, root: str) -> DataFrame:
    """Rows that could not be read, as far as their fields could, with the reasons."""
    return read_folder(spark, f"{root}/delivered", _stored(table)).filter(F.size("reasons") > 0).drop("batch")
