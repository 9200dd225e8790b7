"""What was known when: time travel and the audit trail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.errors import LedgerError, MetricError
from stagewise.operators.arguments import stage_name
from stagewise.operators.measures import FUNNEL
from stagewise.operators.provenance import provenance
from stagewise.schemas import STAGES
from stagewise.sources.ledger import Ledger, parse_moment


def compare_as_of(ledger: Ledger, as_of_date: str | dt.date | dt.datetime, stage: str = "lead",
                  now: dt.datetime | None = None) -> DataFrame:
    """Events of a stage in the snapshot live at a moment, and in the current one.

    Not a date filter: events of old days that arrived later were not known then.
    Both counts come from one read of the stage column unless the table was
    replaced in between.
    """
    stage = stage_name(stage)
    timeline = ledger.timeline(FUNNEL)
    try:
        then = timeline.as_of(as_of_date)
    except LedgerError as error:
        raise MetricError(str(error)) from error
    latest = timeline.at()
    held = {c.snapshot_id for c in timeline.live(then.snapshot_id)}
    kept = held <= {c.snapshot_id for c in timeline.live()}

    def counted(snapshot_id: int, only: set[int] | None) -> DataFrame:
        rows = ledger.read(FUNNEL, snapshot_id, with_commit=True, timeline=timeline)
        rows = rows.filter(F.col("stage") == stage)
        known = F.lit(True) if only is None else F.col("commit_id").isin(*only)
        return rows.agg(F.count_if(known).alias("then"), F.count(F.lit(1)).alias("now"))

    if kept:
        counts = counted(latest.snapshot_id, held)
    else:
        before = counted(then.snapshot_id, None).select("then").scalar()
        counts = counted(latest.snapshot_id, None).withColumn("then", before)
    cutoff, inclusive = parse_moment(as_of_date)
    day = cutoff if inclusive else cutoff - dt.timedelta(microseconds=1)
    cited = {FUNNEL: latest.snapshot()}
    return counts.select(
        F.lit(stage).alias("stage"), F.lit(str(as_of_date)).alias("as_of_requested"),
        F.col("then").alias("historical_events"),
        F.lit(then.snapshot_id).alias("historical_snapshot_id"),
        F.lit(then.committed_at).alias("historical_committed_at"),
        F.col("now").alias("current_events"),
        F.lit(latest.snapshot_id).alias("current_snapshot_id"),
        F.lit(latest.committed_at).alias("current_committed_at"),
        (F.col("now") - F.col("then")).alias("events_added_since"),
        provenance(cited, [FUNNEL], [],
                   f"events of the stage in the snapshot live then ({then.snapshot_id}) against "
                   f"the current one ({latest.snapshot_id})",
                   F.lit(None), F.lit(day.date()), now=now))


def stage_totals(ledger: Ledger) -> DataFrame:
    """Events of every stage in every snapshot: ``snapshot_id, committed_at, stage, events``.

    The fact is read once whatever is asked later: rows are counted by the commit they came with,
    and a snapshot is the sum over the commits since the last one that replaced the table.
    """
    added = (ledger.read_every_commit(FUNNEL).groupBy(F.col("commit_id").alias("snapshot_id"), "stage")
             .agg(F.count(F.lit(1)).alias("added")))
    order = Window.partitionBy("stage").orderBy("committed_at", "snapshot_id")
    grid = ledger.log(FUNNEL).select("snapshot_id", "committed_at", "operation", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    replaced = F.sum((F.col("operation") == "overwrite").cast("int")).over(order)
    return (grid.withColumn("epoch", replaced).join(added, ["snapshot_id", "stage"], "left")
            .select("snapshot_id", "committed_at", "stage", F.sum(F.coalesce("added", F.lit(0))).over(
                Window.partitionBy("stage", "epoch").orderBy("committed_at", "snapshot_id")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("events")))


def compare_as_of_all(ledger: Ledger, moments: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Bulk form: every stage at every moment of ``moments(as_of)``, as texts in the spellings of the single form.

    A text that is no moment, or lies before the first commit, keeps one row with a ``note`` and no stage.
    """
    newest = lambda c: F.max_by(c, F.struct("committed_at", "snapshot_id")).over(Window.partitionBy("stage"))
    asked = ledger.resolve_moments(FUNNEL, moments.select("as_of").distinct())
    totals = stage_totals(ledger).select(
        F.col("snapshot_id").alias("known"), "stage", F.col("events").alias("historical_events"), newest("events").alias("current_events"),
        newest("snapshot_id").alias("current_snapshot_id"), newest("committed_at").alias("current_committed_at"))
    cutoff = F.date_trunc("day", F.col("cutoff"))
    return (asked.join(totals, asked["snapshot_id"] == totals["known"], "left")
            .select("stage", F.col("as_of").alias("as_of_requested"), "historical_events",
                    F.col("snapshot_id").alias("historical_snapshot_id"), F.col("committed_at").alias("historical_committed_at"),
                    "current_events", "current_snapshot_id", "current_committed_at",
                    (F.col("current_events") - F.col("historical_events")).alias("events_added_since"), "note",
                    provenance({FUNNEL: ledger.timeline(FUNNEL).at().snapshot()}, [FUNNEL], [],
                               "events of each stage summed over the commits held at the moment, against all commits held now",
                               F.lit(None), cutoff.cast("date"), now=now)))


def snapshot_history(ledger: Ledger, table: str = FUNNEL,
                     now: dt.datetime | None = None) -> DataFrame:
    """Every commit, oldest first."""
    history = ledger.timeline(table).commits
    if not history:
        raise MetricError(f"{table} has no snapshots")
    log = ledger.log(table)
    cited = {table: history[-1].snapshot()}
    return log.select(
        "snapshot_id", F.col("committed_at").alias("snapshot_committed_at"), "operation",
        "added_records", "total_records",
        (F.col("snapshot_id") == history[-1].snapshot_id).alias("is_current"),
        provenance(cited, [table], [], "every commit of the table, oldest to newest",
                   F.lit(history[0].committed_at.date()),
                   F.lit(history[-1].committed_at.date()), now=now))
