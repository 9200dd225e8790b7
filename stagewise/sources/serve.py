"""A disposable serving copy of the six tables, written by the executors."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from stagewise.errors import LedgerError
from stagewise.operators.fingerprint import watched
from stagewise.schemas import TABLES
from stagewise.star import Star

ROWS_PER_INSERT = 10_000

# column types a database must not turn into text
_SQL_TYPES = {T.DateType(): "DATE", T.TimestampType(): "TIMESTAMP"}


def column_types(table: str) -> str:
    """``createTableColumnTypes`` for the dates and timestamps of a table."""
    return ", ".join(f"{f.name} {_SQL_TYPES[f.dataType]}" for f in TABLES[table]
                     if f.dataType in _SQL_TYPES)


def serve_jdbc(star: Star, url: str, properties: Mapping[str, str], writers: int = 8) -> None:
    """Replace each table in a database, written in batches by several tasks at once."""
    for table, schema in TABLES.items():
        frame = star.table(table).select(*schema.fieldNames())
        writer = (frame.write.mode("overwrite").option("batchsize", ROWS_PER_INSERT)
                  .option("numPartitions", writers))
        if column_types(table):
            writer = writer.option("createTableColumnTypes", column_types(table))
        writer.jdbc(url, table, properties=dict(properties))


def serve_files(star: Star, root: str) -> None:
    """The same copy as plain Parquet folders, one per table."""
    for table, schema in TABLES.items():
        star.table(table).select(*schema.fieldNames()).write.mode("overwrite").parquet(
            f"{root}/{table}")


def serve_files_watched(star: Star, root: str) -> DataFrame:
    """The same copy, and ``table_name, rows, one, two``: the fingerprint of each table's rows as they were written.

    A table is made from its sources once, for the copy and its fingerprint alike."""
    seen: dict[str, Observation] = {}

    def watch(table: str) -> DataFrame:
        frame, seen[table] = watched(star.table(table).select(*TABLES[table].fieldNames()))
        return frame

    serve_files(star.with_tables(**{t: partial(watch, t) for t in TABLES}), root)
    return star.spark.createDataFrame([(t, *(o.get[c] for c in ("rows", "one", "two"))) for t, o in seen.items()],
                                      "table_name string, rows long, one string, two string")


def served_files(spark: SparkSession, root: str) -> Star:
    return Star(**{t: require_types(spark.read.parquet(f"{root}/{t}"), t) for t in TABLES})


def require_types(frame: DataFrame, table: str) -> DataFrame:
    """Refuse a copy whose columns came back with other types."""
    want = {f.name: f.dataType for f in TABLES[table]}
    got = {f.name: f.dataType for f in frame.schema}
    wrong = [f"{n}: {got.get(n)} instead of {t}" for n, t in want.items() if got.get(n) != t]
    if wrong:
        raise LedgerError(f"serving copy of {table} has {'; '.join(wrong)}")
    return frame
