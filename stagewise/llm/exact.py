"""Exact duplicates by a stream with keyed state.

Files arrive as a stream; its state, kept on the executors' disks and in the checkpoint folder,
never expires.  For every digest it retains a stable identifier (the largest ``doc_id`` so far),
the locator of that row's content (file and row number), and the number of rows.  It holds no
text.  Counts are added up inside each task before rows meet, so a text that a third of all rows
share is one row per task.  Every trigger writes the entries it changed; a replayed trigger
replaces its own folder, and a later run reads only files that are new.

A digest that was hit is proved on the full bytes: the content at its locator and the contents of
all other rows of the digest are brought together, equal ones merged where they are read, and a
digest with more than one content is settled by its contents instead.

Defined results: a null text equals an empty one; the row that stays is the one with the largest
id, rows without an id below all others, and of rows that repeat an id the last by file and row
number, so one row of every group stays; an empty folder gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stagewise.llm.common import Scratch

#: Digests that several rows share are broadcast up to so many (of some 150 bytes), and joined by a shuffle beyond.
SMALL_DIGESTS = 200_000
#: A backlog is taken in about so many triggers.
TRIGGERS = 4
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # else every partition of the state reserves 4 MB of disk, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_ENTRY = "digest binary, keep struct<doc_id: bigint, file: string, row: bigint>, group_size bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(frame: DataFrame) -> DataFrame:
    """``doc_id, text, file, row`` of a frame over Parquet files, streaming or not."""
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


class ExactDedup:
    """Duplicates of all rows seen so far; ``root`` holds the state and outlives the session."""

    def __init__(self, spark: SparkSession, root: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.root, self.digest = spark, root, digest

    def ingest(self, rows: DataFrame) -> StreamingQuery:
        """Start on what is new in a stream of ``doc_id, text, file, row``, and stop at its end."""
        entries = (rows.select("doc_id", "file", "row", self.digest(F.col("text")).alias("digest")).groupBy("digest")
                   .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
        updates = f"{self.root}/updates"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        self.spark.createDataFrame([], _ENTRY).write.mode("overwrite").parquet(f"{updates}/batch=-1")
        with _settings(self.spark, _STATE):  # a query keeps the settings it was started under
            return (entries.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/state")
                    .foreachBatch(keep).trigger(availableNow=True).start())

    def entries(self) -> DataFrame:
        """The newest entry of every digest: ids and counts only ever grow."""
        return (self.spark.read.schema(f"{_ENTRY}, batch int").parquet(f"{self.root}/updates").groupBy("digest")
                .agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size")))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256`` of rows that were ingested."""
        scratch = Scratch(self.spark, "exact")
        shared = scratch.write(self.entries().filter("group_size > 1"), "shared")
        rows = rows.withColumn("digest", self.digest(F.col("text")))
        few = shared.count() <= SMALL_DIGESTS
        near = F.broadcast if few else (lambda frame: frame)
        contents = (rows.join(near(shared.select("digest")), "digest").groupBy("digest", "text")
                    .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
        proved = (contents.select("digest").groupBy("digest").agg(F.count(F.lit(1)).alias("contents"))
                  .filter("contents > 1").select("digest"))
        unlike = scratch.write(proved, "unlike")
        found = (rows.withColumn("text_sha256", F.sha2("text", 256)).drop("text")
                 .join(near(shared), "digest", "left"))
        if not unlike.isEmpty():
            own = rows.join(unlike, "digest", "left_semi")
            per = contents.join(unlike, "digest", "left_semi")
            again = (own.withColumn("text_sha256", F.sha2("text", 256)).join(per, ["digest", "text"]).drop("text"))
            found = found.join(unlike, "digest", "left_anti").unionByName(again)
        here = F.col("keep").isNull() | ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))
        return found.select(
            "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), here.alias("kept"), "text_sha256")


def exact_duplicates(spark: SparkSession, path: str, triggers: int = TRIGGERS) -> DataFrame:
    """The verdict on every row of a Parquet file or folder, read as a stream of its files."""
    rows = spark.read.parquet(path)
    per = max(1, -(-len(rows.inputFiles()) // triggers))
    # the last letter as a pattern: a stream takes one file only by a pattern
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per)
              .parquet(f"{path[:-1]}[{path[-1]}]"))
    dedup = ExactDedup(spark, f"{Scratch(spark, 'exact-state').root}")
    dedup.ingest(located(stream)).awaitTermination()
    return dedup.verdicts(located(rows))


EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
