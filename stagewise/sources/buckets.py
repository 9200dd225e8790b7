"""Facts stored by bucket of a key, so that joins on it move no rows.

Two tables cut into the same number of buckets by the same key lie side by side: a join on the key
reads bucket by bucket, and an aggregate by the key needs no exchange either.  The shuffle is paid
once, when the tables are written, and rows are dealt before they are written, so each bucket is
one file.  A bucket is read by one task; a key that holds many rows makes its bucket large, which
is the price: where one key may hold a share of all rows, join the plain tables instead and let
the engine split it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from stagewise.session import workspace

#: Rows of one bucket, about.
BUCKET_ROWS = 4_000_000


def buckets_for(rows: int) -> int:
    """A power of two, so that tables of other sizes divide each other's buckets."""
    return 1 << max(3, (max(1, -(-rows // BUCKET_ROWS)) - 1).bit_length())


def store_bucketed(frame: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The frame as a table of the session, in the shared folder, cut by ``key``."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError(f"not a table name: {name!r}")
    spark: SparkSession = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (frame.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", f"{workspace(spark)}/buckets/{table}").saveAsTable(table))
    return spark.table(table)
