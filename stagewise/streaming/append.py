"""Raw fact files appended as they arrive, each micro-batch one commit.

The batch id is stored with the commit.  A batch replayed after a failure finds
its commit and adds nothing; one that failed before its ledger row was written
left files no read will open, and is written again under a new id.  Rows with a field that cannot
be read go to the reject folder with their reasons, so no row vanishes and no value turns null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stagewise.sources.checked import good_rows, typed_rejects
from stagewise.sources.ledger import Ledger
from stagewise.sources.raw import normalise_times
from stagewise.streaming.files import stream_rows


def commit_batch(ledger: Ledger, table: str, stream: str, rejects: str,
                 raw: DataFrame, batch_id: int) -> None:
    good, bad = normalise_times(raw, table)
    ledger.append(table, good, batch=f"{stream}:{batch_id}")
    # one folder per batch, replaced on replay
    bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")


def commit_checked(ledger: Ledger, table: str, stream: str, rejects: str, checked: DataFrame, batch_id: int) -> None:
    ledger.append(table, good_rows(checked), batch=f"{stream}:{batch_id}")
    typed_rejects(checked, table).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")


def append_files(ledger: Ledger, table: str, source: str, checkpoint: str,
                 stream: str, rejects: str,
                 max_files: int | None = None) -> StreamingQuery:
    """Append every file of a folder not appended yet, then stop."""
    return (stream_rows(ledger.spark, table, source, max_files).writeStream
            .foreachBatch(lambda rows, n: commit_checked(ledger, table, stream, rejects, rows, n))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
