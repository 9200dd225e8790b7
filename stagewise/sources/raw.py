"""Raw delimited files under an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.schemas import FACT_TIME, TABLES, raw_schema


def load_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table from files with a header; fact times are still text."""
    return spark.read.schema(raw_schema(table)).option("header", True).csv(path)


def write_csv(frame: DataFrame, path: str, table: str) -> None:
    """The raw form of a table, with times as ISO text."""
    ts = FACT_TIME.get(table)
    columns = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c == ts else F.col(c)
               for c in TABLES[table].fieldNames()]
    frame.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def parse_time(text: Column) -> Column:
    """Text in any ISO spelling as a timestamp, null if it is none.

    Text must start with a year: a bare time of day would otherwise be read as
    a moment of the current day.
    """
    return F.when(text.rlike(r"^\s*[0-9]{4}"), text.try_cast("timestamp"))


def normalise_times(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose time parses, and apart from them the rows to look at."""
    ts = FACT_TIME[table]
    parsed = raw.withColumn("parsed", parse_time(F.col(ts)))
    good = (parsed.filter(F.col("parsed").isNotNull())
            .withColumn(ts, F.col("parsed")).drop("parsed"))
    return good, parsed.filter(F.col("parsed").isNull()).drop("parsed")


def load_table(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame | None]:
    """A table with typed times, and the rejected rows if it is a fact."""
    raw = load_csv(spark, path, table)
    return normalise_times(raw, table) if table in FACT_TIME else (raw, None)
