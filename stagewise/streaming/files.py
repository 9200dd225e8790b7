"""Raw fact files as a checked stream, and folders that a replayed trigger replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stagewise.sources.checked import check_rows, reader_options, text_schema

Trigger = dict[str, object]


def stream_rows(spark: SparkSession, table: str, source: str, max_files: int | None = None) -> DataFrame:
    """The rows of a folder as they arrive, typed, with their raw fields and the reasons against them."""
    reader = spark.readStream.schema(text_schema(table)).options(**reader_options(header=True))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return check_rows(reader.csv(source), table)


def keep_batch(root: str):
    """A sink with one folder per trigger; a trigger that runs again writes its folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write


def start_folder(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """An empty folder of no trigger, so that there is something to read before the first one."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/batch=-1")


def read_folder(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(root)
