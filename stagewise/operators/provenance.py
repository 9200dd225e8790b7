"""The receipts attached to every answer.

``as_of_date`` is when the answer was computed, ``snapshot_committed_at`` when
the data behind it was written.  An answer drawn from two tables names both
snapshots, each next to its own commit time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.errors import MetricError
from stagewise.star import Snapshot

SNAPSHOT = ("struct<snapshot_id:string,snapshot_committed_at:timestamp,operation:string,"
            "total_records:bigint,source_tables:array<string>,measures:array<string>>")
REQUIRED = ("snapshot_id", "snapshot_committed_at", "as_of_date", "date_range",
            "source_tables", "calculation")


def provenance(snapshots: Mapping[str, Snapshot], facts: Sequence[str], dims: Sequence[str], calculation: str | Column,
               start: Column, end: Column, prior_start: Column | None = None,
               prior_end: Column | None = None, now: dt.datetime | None = None,
               scan: Column | None = None,
               measures: Mapping[str, Sequence[str]] | None = None) -> Column:
    """One struct column.  ``facts`` name the tables whose snapshots are cited."""
    none = F.lit(None)
    cited = [snapshots[f] for f in facts if f in snapshots]
    entries = [
        F.struct(
            F.lit(str(s.snapshot_id)).alias("snapshot_id"),
            F.lit(s.committed_at).alias("snapshot_committed_at"),
            F.lit(s.operation).alias("operation"),
            F.lit(s.total_records).cast("bigint").alias("total_records"),
            F.array(F.lit(s.table), *[F.lit(d) for d in dims]).alias("source_tables"),
            F.array(*[F.lit(m) for m in (measures or {}).get(s.table, ())])
            .cast("array<string>").alias("measures")).cast(SNAPSHOT)
        for s in cited]
    newest = max(cited, key=lambda s: s.committed_at) if cited else None
    one = cited[0] if len(cited) == 1 else None
    return F.struct(
        F.lit(", ".join(str(s.snapshot_id) for s in cited) or None).cast("string")
        .alias("snapshot_id"),
        F.lit(newest and newest.committed_at).cast("timestamp").alias("snapshot_committed_at"),
        F.lit(newest and newest.operation).cast("string").alias("operation"),
        F.lit(one and one.total_records).cast("bigint").alias("total_records"),
        (F.lit(now) if now else F.current_timestamp()).cast("timestamp").alias("as_of_date"),
        F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"),
                 (none if prior_start is None else prior_start).cast("date").alias("prior_start"),
                 (none if prior_end is None else prior_end).cast("date").alias("prior_end"))
        .alias("date_range"),
        F.array(*[F.lit(t) for t in (*facts, *dims)]).alias("source_tables"),
        (F.lit(calculation) if isinstance(calculation, str) else calculation)
        .alias("calculation"),
        F.array(*entries).cast(f"array<{SNAPSHOT}>").alias("snapshots"),
        (none if scan is None else scan)
        .cast("struct<files_total:bigint,files_scanned:bigint,files_skipped:bigint>")
        .alias("scan"),
    ).alias("provenance")


def require_provenance(frame: DataFrame) -> DataFrame:
    """Refuse an answer that does not say where its numbers came from."""
    kind = frame.schema["provenance"].dataType if "provenance" in frame.columns else None
    held = kind.fieldNames() if isinstance(kind, T.StructType) else []
    missing = [f for f in REQUIRED if f not in held]
    if missing:
        raise MetricError(f"answer lacks provenance: {', '.join(missing)}")
    return frame
