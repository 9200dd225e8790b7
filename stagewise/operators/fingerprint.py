"""Two copies of a table compared without moving their rows.

A row becomes two hashes of all its columns.  Rows are put into ranges by a hash of their key, and a
range is described by its number of rows and the sums of both hashes, which do not depend on the
order rows come in and count repeated rows as often as they occur.  Only these sums are shuffled.
Ranges that agree are done; those that differ are cut further, and what is left at the end, a few
rows around each difference, is joined by key to name the keys.

A table that is being written tells its fingerprint on the way (``watched``): what took a join to
make is then not made a second time only to be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Each step cuts a range into so many.
FAN = 4096
#: Finer ranges that differ are broadcast up to so many; beyond, what differs is most of the tables.
FEW = 500_000
_SUM = "decimal(38,0)"


def _hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of a row.  A null is told from a value beside it."""
    known = [F.col(c).isNull() for c in columns]
    values = [F.col(c) for c in columns]
    return F.xxhash64(*values, *known), F.xxhash64(F.lit("other"), *reversed(values), *known)


def _hashed(frame: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key columns, place of the key, and two hashes of the row."""
    one, two = _hashes(columns)
    return frame.select(*key, F.xxhash64(*key).alias("fp_place"), one.alias("fp_one"), two.alias("fp_two"))


def _range(step: int) -> Column:
    """The range of a place: 12 more of its bits with every step."""
    return F.pmod(F.col("fp_place"), F.lit(FAN ** (step + 1)))


def _sums(rows: DataFrame, step: int, side: str) -> DataFrame:
    return rows.groupBy(_range(step).alias("fp_range")).agg(
        F.count(F.lit(1)).alias(f"{side}_n"), F.sum(F.col("fp_one").cast(_SUM)).alias(f"{side}_one"),
        F.sum(F.col("fp_two").cast(_SUM)).alias(f"{side}_two"))


def unlike_ranges(left: DataFrame, right: DataFrame, step: int) -> DataFrame:
    """Ranges in which two hashed tables differ."""
    both = _sums(left, step, "l").join(_sums(right, step, "r"), "fp_range", "full")
    same = F.lit(True)
    for part in ("n", "one", "two"):
        same = same & F.col(f"l_{part}").eqNullSafe(F.col(f"r_{part}"))
    return both.filter(~same).select("fp_range")


def differing_keys(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``key..., left_rows, right_rows, difference`` of every key that is not alike on both sides."""
    key, columns = list(key), list(columns or left.columns)
    one, two = _hashed(left, key, columns), _hashed(right, key, columns)
    first = [r.fp_range for r in unlike_ranges(one, two, 0).collect()]  # FAN numbers at most
    one, two = (rows.filter(_range(0).isin(first)) if first else rows.limit(0) for rows in (one, two))
    if first:
        finer = unlike_ranges(one, two, 1).limit(FEW + 1).toArrow()  # one number a range, found once
        if finer.num_rows <= FEW:
            ranges = F.broadcast(left.sparkSession.createDataFrame(finer))
            one, two = (rows.withColumn("fp_range", _range(1)).join(ranges, "fp_range", "left_semi").drop("fp_range")
                        for rows in (one, two))
    sides = []
    for name, rows in (("left", one), ("right", two)):
        own = [F.col(k).alias(f"{name}_{k}") for k in key]
        sides.append(rows.groupBy(*own).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.sum(F.col("fp_one").cast(_SUM)).alias(f"{name}_one"),
                                            F.sum(F.col("fp_two").cast(_SUM)).alias(f"{name}_two")))
    match = [F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}")) for k in key]
    both = sides[0].join(sides[1], match, "full")
    alike = F.col("left_one").eqNullSafe(F.col("right_one")) & F.col("left_two").eqNullSafe(F.col("right_two")) & F.col(
        "left_rows").eqNullSafe(F.col("right_rows"))
    count = lambda side: F.coalesce(F.col(f"{side}_rows"), F.lit(0)).cast("long")
    kind = (F.when(F.col("left_rows").isNull(), "only on the right").when(F.col("right_rows").isNull(), "only on the left")
            .when(F.col("left_rows") != F.col("right_rows"), "another number of rows").otherwise("other values"))
    return both.filter(~alike).select(*[F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in key], count("left").alias("left_rows"),
                                      count("right").alias("right_rows"), kind.alias("difference"))


def _totals(columns: Sequence[str]) -> list[Column]:
    one, two = (F.coalesce(F.sum(h.cast(_SUM)), F.lit(0)).cast("string") for h in _hashes(columns))
    return [F.count(F.lit(1)).alias("rows"), one.alias("one"), two.alias("two")]


def fingerprint(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``rows, one, two`` that two tables share exactly when they hold the same rows, whatever the order."""
    return frame.agg(*_totals(list(columns or frame.columns)))


def watched(frame: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, and the fingerprint of those that pass, known after the one write they are put to."""
    seen = Observation()
    return frame.observe(seen, *_totals(list(columns or frame.columns))), seen
