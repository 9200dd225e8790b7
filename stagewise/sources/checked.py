"""Raw delimited files read with a reason for every row that can not be taken.

A row is read as text and each field is cast on its own, so one broken number costs neither the
file nor, silently, the value: a row is either good, with every field of its table typed, or
rejected with all its reasons.  Everything is one narrow pass of built-in functions, so it reads
a file or a stream alike and pushes nothing through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.schemas import FACT_TIME, TABLES
from stagewise.sources.raw import parse_time

RECORD = "broken_record"
#: A comma outside of quotes: an even number of quotes follows.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_NOUN = {T.IntegerType: "a whole number", T.LongType: "a whole number", T.DoubleType: "a number", T.DateType: "a date",
         T.TimestampType: "a time"}


def text_schema(table: str) -> T.StructType:
    """All fields as text, and the line itself where its number of fields is wrong."""
    names = [*TABLES[table].fieldNames(), RECORD]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def reader_options(header: bool) -> dict[str, object]:
    # without pruning a line is split in full, whatever is asked of it, so its fields can be counted
    return {"header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": False}


def read_text(spark: SparkSession, path: str, table: str, header: bool = True) -> DataFrame:
    return spark.read.schema(text_schema(table)).options(**reader_options(header)).csv(path)


def _typed(field: T.StructField) -> Column:
    text = F.trim(F.col(field.name))
    if isinstance(field.dataType, T.TimestampType):
        return parse_time(text)
    value = text.try_cast(field.dataType)
    if isinstance(field.dataType, T.DoubleType):  # no measure is infinite or no number
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return value


def _reasons(field: T.StructField, short: Column) -> list[Column]:
    empty = F.coalesce(F.trim(F.col(field.name)) == "", F.lit(True))
    out = [F.when(empty & ~short, f"{field.name} is missing")]
    if type(field.dataType) in _NOUN:
        out.append(F.when(~empty & _typed(field).isNull(), f"{field.name} is not {_NOUN[type(field.dataType)]}"))
    return out


def check_rows(text: DataFrame, table: str) -> DataFrame:
    """The typed fields, the fields as they came in ``raw``, and ``reasons``, empty for a good row."""
    fields = TABLES[table].fields
    found = F.regexp_count(F.col(RECORD), F.lit(_COMMA)) + 1
    broken, want = F.col(RECORD).isNotNull(), len(fields)
    short = F.coalesce(broken & (found < want), F.lit(False))  # the fields that are left out are not named one by one
    width = [F.when(broken & (found < want), F.concat(F.lit("columns are missing: "), found, F.lit(f" of {want}"))),
             F.when(broken & (found > want), F.concat(F.lit("columns too many: "), found, F.lit(f" for {want}"))),
             F.when(broken & (found == want), "line can not be split")]
    reasons = F.array_compact(F.array(*width, *[r for f in fields for r in _reasons(f, short)]))
    return text.select(*[_typed(f).alias(f.name) for f in fields],
                       F.struct(*[F.col(f.name) for f in fields], F.col(RECORD)).alias("raw"), reasons.alias("reasons"))


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("raw", "reasons")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """The raw fields and the reasons of the rows that are not good."""
    return checked.filter(F.size("reasons") > 0).select("raw.*", "reasons")


def typed_rejects(checked: DataFrame, table: str) -> DataFrame:
    """Rejected rows with what fields could be read, their time as it came, the raw fields and the reasons."""
    ts = FACT_TIME.get(table)
    rows = checked.filter(F.size("reasons") > 0)
    return rows if ts is None else rows.withColumn(ts, F.col(f"raw.{ts}"))


def load_checked(spark: SparkSession, path: str, table: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows under the table's types, and the rejected ones; together they are all lines of the files."""
    checked = check_rows(read_text(spark, path, table, header), table)
    return good_rows(checked), rejected_rows(checked)


def reject_counts(rejected: DataFrame) -> DataFrame:
    """How many rows each reason is given for; a row counts under each of its reasons."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
