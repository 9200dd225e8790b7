"""Versioned tables: Parquet commits and an append-only ledger of them.

Data of a commit lies under ``<table>/spec=<n>/commit_id=<k>/<layout column>=…``.
The ledger row is written last, and a read opens only the directories of commits
it lists, so a write that failed half way is never seen and time travel is a
choice of directories.  One writer per table is assumed.

What reaches the driver is the ledger itself: one row per commit, never data.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Collection
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.errors import LedgerError
from stagewise.operators.asof import as_of_join
from stagewise.schemas import DIMENSIONS, FACT_TIME, TABLES
from stagewise.session import use_utc
from stagewise.star import Snapshot, Star

UTC = dt.timezone.utc
LEDGER = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("snapshot_id", T.IntegerType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("operation", T.StringType()),
    T.StructField("spec", T.IntegerType()),
    T.StructField("layout", T.StringType()),
    T.StructField("added_files", T.LongType()),
    T.StructField("deleted_files", T.LongType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("added_records", T.LongType()),
    T.StructField("total_records", T.LongType()),
    T.StructField("batch", T.StringType()),
    T.StructField("day_from_key", T.ArrayType(T.IntegerType())),
])
COMMIT_ID = T.StructField("commit_id", T.IntegerType())
LAYOUTS = ("none", "day", "month")
EVOLVE = "evolve"
MAX_ROWS_PER_FILE = 20_000_000


@dataclass(frozen=True)
class Commit:
    """One ledger row."""

    table_name: str
    snapshot_id: int
    committed_at: dt.datetime
    operation: str
    spec: int
    layout: str
    added_files: int
    deleted_files: int
    total_files: int
    added_records: int
    total_records: int
    batch: str | None
    # least and greatest distance from a row's date key to the day of its time;
    # none if it is not known for every row
    day_from_key: list[int] | None = None

    def snapshot(self) -> Snapshot:
        return Snapshot(self.table_name, self.snapshot_id, self.committed_at,
                        self.operation, self.total_records)


#: A date, or a date with a time of day and maybe a zone.
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
NO_MOMENT = "neither a date nor an ISO time"


def parse_moment(value: str | dt.date | dt.datetime) -> tuple[dt.datetime, bool]:
    """``(cutoff, inclusive)``: a date means up to the end of that day, times are UTC."""
    if isinstance(value, str):
        text = value.strip()
        try:
            if not re.match(MOMENT, text):
                raise ValueError(text)
            value = (dt.date if len(text) == 10 else dt.datetime).fromisoformat(text)
        except ValueError as error:
            raise LedgerError(f"{text!r} is {NO_MOMENT}") from error
    if isinstance(value, dt.datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)), True
    if value == dt.date.max:
        return dt.datetime.max.replace(tzinfo=UTC), True
    return dt.datetime.combine(value + dt.timedelta(days=1), dt.time.min, UTC), False


def layout_column(table: str, layout: str) -> str | None:
    return None if layout == "none" else f"{FACT_TIME[table]}_{layout}"


def layout_value(ts: Column, layout: str) -> Column:
    return F.to_date(ts) if layout == "day" else F.date_format(ts, "yyyy-MM")


@dataclass(frozen=True)
class Timeline:
    """The commits of one table, oldest first, and the layouts it has had."""

    table: str
    commits: tuple[Commit, ...]
    layouts: tuple[tuple[int, str], ...] = ()

    def __iter__(self):
        return iter(self.commits)

    def __len__(self) -> int:
        return len(self.commits)

    @property
    def layout(self) -> tuple[int, str]:
        """``(spec, layout)`` that the next commit is written with."""
        default = "day" if self.table in FACT_TIME else "none"
        return self.layouts[-1] if self.layouts else (0, default)

    def _held(self) -> tuple[Commit, ...]:
        if not self.commits:
            raise LedgerError(f"{self.table} has no snapshots")
        return self.commits

    def at(self, snapshot_id: int | None = None) -> Commit:
        """The current commit, or a named one."""
        held = self._held()
        if snapshot_id is None:
            return held[-1]
        for commit in held:
            if commit.snapshot_id == int(snapshot_id):
                return commit
        raise LedgerError(f"{self.table} has no snapshot {snapshot_id}; "
                          f"held: {[c.snapshot_id for c in held]}")

    def as_of(self, moment: str | dt.date | dt.datetime) -> Commit:
        """The newest commit at or before a moment."""
        cutoff, inclusive = parse_moment(moment)
        held = self._held()
        known = [c for c in held
                 if c.committed_at < cutoff or (inclusive and c.committed_at == cutoff)]
        if not known:
            raise LedgerError(
                f"{self.table} had no snapshot at {moment}; its commits run from "
                f"{held[0].committed_at.isoformat()} until {held[-1].committed_at.isoformat()}")
        return known[-1]

    def live(self, snapshot_id: int | None = None) -> list[Commit]:
        """Commits whose rows make up a snapshot: from its last overwrite on."""
        last = self.at(snapshot_id)
        upto = [c for c in self.commits if c.snapshot_id <= last.snapshot_id]
        start = max((i for i, c in enumerate(upto) if c.operation == "overwrite"), default=0)
        return upto[start:]

    def day_span(self, keys: Collection[int],
                 snapshot_id: int | None = None) -> tuple[dt.date, dt.date] | None:
        """Days outside which no live row has one of the date keys, if that is known."""
        held = [c.day_from_key for c in self.live(snapshot_id) if c.added_records]
        if not held or not keys or any(d is None for d in held):
            return None
        epoch = dt.date(1970, 1, 1)
        first = min(keys) + min(low for low, _ in held)
        last = max(keys) + max(high for _, high in held)
        return epoch + dt.timedelta(days=first), epoch + dt.timedelta(days=last)


class Ledger:
    """Versioned tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = use_utc(spark)
        self.root = root.rstrip("/")

    # --- metadata -------------------------------------------------------------

    def _children(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _records(self, table: str | None = None) -> DataFrame:
        """Ledger rows of one table, or of all.  Each table has a folder of its own,
        so that writers of different tables do not meet."""
        path = f"{self.root}/ledger" + (f"/{table}" if table else "")
        if not self._children(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)

    def _record(self, table: str, rows: list[Commit]) -> None:
        """Add ledger rows of a table in one file, all or none."""
        epoch = dt.datetime(1970, 1, 1, tzinfo=UTC)
        micro = dt.timedelta(microseconds=1)
        text = json.dumps([{**asdict(r), "committed_at": (r.committed_at - epoch) // micro}
                           for r in rows])
        kinds = T.StructType([T.StructField(f.name, T.LongType()) if f.name == "committed_at" else f
                              for f in LEDGER])
        (self.spark.range(0, 1, 1, 1)
         .select(F.inline(F.from_json(F.lit(text), T.ArrayType(kinds))))
         .withColumn("committed_at", F.timestamp_micros("committed_at"))
         .write.mode("append").parquet(f"{self.root}/ledger/{table}"))

    def log(self, table: str | None = None) -> DataFrame:
        """The commits as a frame, oldest first when one table is asked for."""
        frame = self._records(table).filter(F.col("operation") != EVOLVE)
        return frame if table is None else frame.orderBy("committed_at", "snapshot_id")

    def _timelines(self, tables: Collection[str], records: DataFrame) -> dict[str, Timeline]:
        # epoch microseconds: a collected timestamp would be shifted to the
        # time zone of the driver
        rows = records.withColumn("committed_at", F.unix_micros("committed_at")).collect()
        epoch = dt.datetime(1970, 1, 1, tzinfo=UTC)
        entries = [Commit(**{**r.asDict(),
                             "committed_at": epoch + dt.timedelta(microseconds=r.committed_at)})
                   for r in rows]
        out = {}
        for table in tables:
            own = [c for c in entries if c.table_name == table]
            commits = sorted((c for c in own if c.operation != EVOLVE),
                             key=lambda c: (c.committed_at, c.snapshot_id))
            out[table] = Timeline(table, tuple(commits),
                                  tuple(sorted({(c.spec, c.layout) for c in own})))
        return out

    def timeline(self, table: str) -> Timeline:
        return self._timelines([table], self._records(table))[table]

    def evolve(self, table: str, layout: str) -> tuple[int, str]:
        """Later commits use ``layout``; files already written stay as they are."""
        if layout not in LAYOUTS:
            raise LedgerError(f"layout must be one of {', '.join(LAYOUTS)}, got {layout!r}")
        line = self.timeline(table)
        if line.layouts and line.layout[1] == layout:
            return line.layout
        used = (line.layout[0] + 1 if line.layouts else 0, layout)
        self._record(table, [Commit(table, 0, dt.datetime.now(UTC), EVOLVE, *used, 0, 0, 0, 0, 0, None)])
        return used

    # --- snapshots ------------------------------------------------------------

    def resolve_moments(self, table: str, moments: DataFrame) -> DataFrame:
        """Bulk form of ``as_of`` over ``moments(as_of)``: the same spellings, and a ``note``
        where a text is no moment or lies before the first commit.

        Moments and commits are sorted together and the commit before a moment is carried to it, so
        the work is that of the moments asked and the commits held, on one day or on many.
        """
        text = F.trim(F.col("as_of"))
        known = F.when(text.rlike(MOMENT), text)
        end_of_day = known.try_cast("date").cast("timestamp") + F.expr("interval '23:59:59.999999' hour to second")
        cutoff = F.when(F.length(known) == 10, end_of_day).otherwise(
            # a time without seconds, which the cast would refuse before a zone
            F.regexp_replace(known, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2").try_cast("timestamp"))
        found = as_of_join(moments.withColumn("cutoff", cutoff), self.log(table), "cutoff", "committed_at",
                           ["snapshot_id", "committed_at"], tie="snapshot_id")
        return found.withColumn("note", F.when(F.col("cutoff").isNull(), NO_MOMENT)
                                .when(F.col("snapshot_id").isNull(), "before the first commit"))

    # --- reads ----------------------------------------------------------------

    def _parts(self, table: str, commits: list[Commit]) -> list[tuple[str, DataFrame]]:
        """Per layout, the rows of the given commits with their partition columns.

        Only the directories of these commits are listed, and the partition
        types are given, so no file is opened to find out what there is.
        """
        layouts = {c.spec: c.layout for c in commits if c.added_files}
        parts = []
        for spec, layout in sorted(layouts.items()):
            base = f"{self.root}/{table}/spec={spec}"
            schema = T.StructType([*TABLES[table].fields, COMMIT_ID])
            column = layout_column(table, layout)
            if column:
                schema = schema.add(column, T.DateType() if layout == "day" else T.StringType())
            paths = [f"{base}/commit_id={c.snapshot_id}"
                     for c in commits if c.spec == spec and c.added_files]
            parts.append((layout, self.spark.read.schema(schema)
                          .option("basePath", base).parquet(*paths)))
        return parts

    def parts(self, table: str) -> list[tuple[str, DataFrame]]:
        """The current rows as one frame per layout, partition columns included."""
        return self._parts(table, self.timeline(table).live())

    def _union(self, table: str, frames: list[DataFrame]) -> DataFrame:
        columns = [*TABLES[table].fieldNames(), "commit_id"]
        if not frames:
            empty = T.StructType([*TABLES[table].fields, COMMIT_ID])
            return self.spark.createDataFrame([], empty)
        return reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])

    def read(self, table: str, snapshot_id: int | None = None, with_commit: bool = False,
             timeline: Timeline | None = None) -> DataFrame:
        """The rows live at a snapshot, across all layouts."""
        timeline = timeline or self.timeline(table)
        frames = [f for _, f in self._parts(table, timeline.live(snapshot_id))]
        out = self._union(table, frames)
        return out if with_commit else out.drop("commit_id")

    def read_every_commit(self, table: str) -> DataFrame:
        """The rows of all commits, replaced ones too, with the commit each came with."""
        timeline = self.timeline(table)
        return self._union(table, [f for _, f in self._parts(table, list(timeline.commits))])

    def in_layout_range(self, table: str, start: dt.datetime, end: dt.datetime,
                        snapshot_id: int | None = None,
                        timeline: Timeline | None = None) -> list[DataFrame]:
        """Per layout, the files a half-open time range can touch: partition predicate only."""
        timeline = timeline or self.timeline(table)
        out = []
        for layout, frame in self._parts(table, timeline.live(snapshot_id)):
            column = layout_column(table, layout)
            if column:
                low = layout_value(F.lit(start), layout)
                high = layout_value(F.lit(end - dt.timedelta(microseconds=1)), layout)
                frame = frame.filter(F.col(column).between(low, high))
            out.append(frame)
        return out

    def on_days(self, table: str, keys: Collection[int], snapshot_id: int | None = None,
                timeline: Timeline | None = None) -> DataFrame:
        """Rows with one of the date keys, opening only the files that can hold any.

        Each commit records how far a date key lies from the day of its row, so
        keys bound the partitions without trusting the two to agree.
        """
        timeline = timeline or self.timeline(table)
        span = timeline.day_span(keys, snapshot_id)
        if span is None:
            rows = self.read(table, snapshot_id, timeline=timeline)
        else:
            start = dt.datetime.combine(span[0], dt.time.min, UTC)
            end = dt.datetime.combine(span[1] + dt.timedelta(days=1), dt.time.min, UTC)
            rows = self._union(table, self.in_layout_range(
                table, start, end, snapshot_id, timeline)).drop("commit_id")
        return rows.filter(F.col("date_key").isin(*keys))

    def time_range(self, table: str, start: dt.datetime, end: dt.datetime,
                   snapshot_id: int | None = None) -> DataFrame:
        """Rows with ``start <= time < end``; files outside the range are not opened.

        The exact predicate alone would open every file: plain Parquet knows
        nothing of how a partition column follows from the time.
        """
        start, end = _aware(start), _aware(end)
        ts = F.col(FACT_TIME[table])
        exact = (ts >= F.lit(start)) & (ts < F.lit(end))
        frames = [f.filter(exact) for f in self.in_layout_range(table, start, end, snapshot_id)]
        return self._union(table, frames).drop("commit_id")

    def star(self, moment: str | dt.date | dt.datetime | None = None) -> Star:
        """All six tables as of a moment, or now, with the snapshots they were read at."""
        lines = self._timelines(TABLES, self._records())
        at = {t: line.at() if moment is None else line.as_of(moment) for t, line in lines.items()}
        frames = {t: partial(self.read, t, c.snapshot_id, timeline=lines[t])
                  for t, c in at.items()}
        narrow = {t: partial(self.on_days, t, snapshot_id=at[t].snapshot_id, timeline=lines[t])
                  for t in FACT_TIME}
        return Star({t: c.snapshot() for t, c in at.items()}, narrow, **frames)

    # --- writes ---------------------------------------------------------------

    def _next_id(self, line: Timeline) -> int:
        """Past every id in the ledger and every id a failed write left on disk."""
        base = f"{self.root}/{line.table}"
        on_disk = [int(name.split("=")[1])
                   for spec in self._children(base) if spec.startswith("spec=")
                   for name in self._children(f"{base}/{spec}") if name.startswith("commit_id=")]
        return 1 + max([*on_disk, *[c.snapshot_id for c in line]], default=0)

    def _write(self, line: Timeline, frame: DataFrame,
               ids: list[int]) -> tuple[dict[int, tuple[int, int]], list[int] | None]:
        """Write rows into the directories of their ``commit_id``.

        Returns ``{id: (files, rows)}`` and the distance from date key to day.

        The rebalance brings the rows of one partition directory together, and
        lets the engine split a directory that is too large for one task.  Rows
        lie in time order, so that the statistics of a month file prune within
        it.  Files and rows are counted from what then lies in storage; a write
        of no rows makes no directory.
        """
        spec, layout = line.layout
        column = layout_column(line.table, layout)
        by = ["commit_id", column] if column else ["commit_id"]
        rows = frame.select(*TABLES[line.table].fieldNames(), "commit_id")
        ordered = list(by)
        seen = None
        if column:
            ts = FACT_TIME[line.table]
            rows = rows.withColumn(column, layout_value(F.col(ts), layout))
            ordered.append(ts)
            # extremes stay right when a task runs twice, which a sum would not
            seen = Observation()
            distance = F.unix_date(F.to_date(ts)) - F.col("date_key")
            rows = rows.observe(seen, F.min(distance).alias("low"), F.max(distance).alias("high"),
                                F.max(F.col(ts).isNull()).alias("untimed"))
        base = f"{self.root}/{line.table}/spec={spec}"
        with _all_cores(self.spark):
            (rows.hint("rebalance", *by).sortWithinPartitions(*ordered)
             .write.mode("append").partitionBy(*by)
             .option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(base))

        present = set(self._children(base))
        paths = [f"{base}/commit_id={i}" for i in ids if f"commit_id={i}" in present]
        if not paths:
            return {}, None
        held = seen.get if seen else {"untimed": True}
        known = not held["untimed"] and held["low"] is not None
        distances = [held["low"], held["high"]] if known else None
        per_file = (self.spark.read.schema(T.StructType([COMMIT_ID]))
                    .option("basePath", base).parquet(*paths)
                    .groupBy("commit_id", F.col("_metadata.file_path").alias("file"))
                    .agg(F.count(F.lit(1)).alias("rows")))
        counted = per_file.groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"),
                                                    F.sum("rows").alias("rows"))
        return {r.commit_id: (r["files"], r["rows"]) for r in counted.collect()}, distances

    def _commit(self, line: Timeline,
                entries: list[tuple[int, dt.datetime, str, str | None]],
                written: tuple[dict[int, tuple[int, int]], list[int] | None]) -> list[Commit]:
        """Ledger rows for written commits, in order; this is what makes them visible."""
        last = line.commits[-1] if len(line) else None
        files, records = (last.total_files, last.total_records) if last else (0, 0)
        previous = last.committed_at if last else None
        counts, distances = written
        rows = []
        for snapshot_id, at, operation, batch in entries:
            if previous is not None and at <= previous:
                raise LedgerError(f"commit of {line.table} at {at.isoformat()} is not after "
                                  f"the one at {previous.isoformat()}")
            previous = at
            added_files, added = counts.get(snapshot_id, (0, 0))
            deleted = files if operation == "overwrite" else 0
            files = files - deleted + added_files
            records = added + (0 if operation == "overwrite" else records)
            rows.append(Commit(line.table, snapshot_id, at, operation, *line.layout, added_files,
                               deleted, files, added, records, batch, distances))
        self._record(line.table, rows)
        return rows

    def _in_order(self, line: Timeline, at: dt.datetime | None) -> None:
        """Refuse a commit time that is not after the last one before anything is written."""
        if at is not None and len(line) and _aware(at) <= line.commits[-1].committed_at:
            raise LedgerError(f"commit of {line.table} at {_aware(at).isoformat()} is not after "
                              f"the one at {line.commits[-1].committed_at.isoformat()}")

    def _tip(self, table: str, batch: str | None) -> Timeline:
        """As much of a timeline as the next commit needs: the newest commit, the newest layout and the
        commit of the batch, picked in Spark, so that a long stream does not bring its whole log here each time."""
        records = self._records(table)
        commits = records.filter(F.col("operation") != EVOLVE)
        newest = commits.orderBy(F.desc("committed_at"), F.desc("snapshot_id")).limit(1)
        shape = records.orderBy(F.desc("spec"), F.desc("layout")).limit(1)
        wanted = newest.unionByName(shape)
        if batch is not None:
            wanted = wanted.unionByName(commits.filter(F.col("batch") == batch).limit(1))
        return self._timelines([table], wanted.dropDuplicates(["snapshot_id", "operation", "spec"]))[table]

    def append(self, table: str, frame: DataFrame, committed_at: dt.datetime | None = None,
               batch: str | None = None, operation: str = "append") -> Commit:
        """One commit.  A ``batch`` that was committed before is not committed again."""
        line = self._tip(table, batch)
        done = next((c for c in line if batch is not None and c.batch == batch), None)
        if done:
            return done
        if not len(line):
            operation = "overwrite"
        self._in_order(line, committed_at)
        snapshot_id = self._next_id(line)
        written = self._write(line, frame.withColumn("commit_id", F.lit(snapshot_id)), [snapshot_id])
        at = _aware(committed_at) if committed_at else dt.datetime.now(UTC)
        return self._commit(line, [(snapshot_id, at, operation, batch)], written)[0]

    def overwrite(self, table: str, frame: DataFrame,
                  committed_at: dt.datetime | None = None) -> Commit:
        """Replace the table; older snapshots stay readable."""
        return self.append(table, frame, committed_at, operation="overwrite")

    def load_dimensions(self, star: Star, committed_at: dt.datetime | None = None) -> list[Commit]:
        return [self.overwrite(t, star.table(t), committed_at) for t in DIMENSIONS]

    def load_by_month(self, table: str, frame: DataFrame,
                      committed_at: dt.datetime | None = None) -> list[Commit]:
        """Replace a fact with one commit per calendar month, oldest first.

        All months are written by one job: the month decides the commit a row
        belongs to, instead of one filtered pass over the input per month.
        Commit times step by a millisecond up to ``committed_at``.
        """
        month = F.date_format(F.col(FACT_TIME[table]), "yyyy-MM")
        held = frame.groupBy(month.alias("month")).count().orderBy("month").collect()
        if not held:
            return [self.overwrite(table, frame, committed_at)]
        if held[0].month is None:
            raise LedgerError(f"{held[0]['count']} rows of {table} have no time; "
                              "set them aside before loading")
        line = self.timeline(table)
        if committed_at is not None:
            self._in_order(line, _aware(committed_at) - dt.timedelta(milliseconds=len(held) - 1))
        first = self._next_id(line)
        ids = {row.month: first + i for i, row in enumerate(held)}
        # one row per calendar month
        months = self.spark.createDataFrame(list(ids.items()), "commit_month string, commit_id int")
        rows = (frame.withColumn("commit_month", month)
                .join(F.broadcast(months), "commit_month"))
        written = self._write(line, rows, list(ids.values()))
        last = _aware(committed_at) if committed_at else dt.datetime.now(UTC)
        entries = [(i, last - dt.timedelta(milliseconds=len(ids) - 1 - n),
                    "overwrite" if n == 0 else "append", m)
                   for n, (m, i) in enumerate(ids.items())]
        return self._commit(line, entries, written)


@contextmanager
def _all_cores(spark: SparkSession):
    """Keep a small write of many directories from being merged into one task.

    The time such a write takes is that of opening files, not of its bytes.  A
    directory still goes to one task, so there are no more files than before.
    """
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _aware(moment: dt.datetime) -> dt.datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=UTC)
