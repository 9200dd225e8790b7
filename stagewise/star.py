"""The six tables a question is asked of, and the snapshots they were read at."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.schemas import TABLES


@dataclass(frozen=True)
class Snapshot:
    """One commit of one table."""

    table: str
    snapshot_id: int
    committed_at: dt.datetime
    operation: str
    total_records: int


class Star:
    """Facts and dimensions as lazy frames.

    A table may be given as a function; it is then built when it is first asked
    for, so that a question about two tables costs nothing for the other four.
    ``snapshots`` is empty for tables that are not versioned; the provenance of
    an answer then names no snapshot.  ``narrow`` may give a cheaper way to the
    rows of a fact on a few days.
    """

    def __init__(self, snapshots: Mapping[str, Snapshot] | None = None,
                 narrow: Mapping[str, Callable[[Collection[int]], DataFrame]] | None = None,
                 **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(TABLES):
            raise ValueError(f"a star has the tables {', '.join(TABLES)}")
        self._tables = tables
        self._kept: dict[str, DataFrame] | None = None
        self._narrow = dict(narrow or {})
        self.snapshots = dict(snapshots or {})

    def table(self, name: str) -> DataFrame:
        held = self._tables[name]
        if not isinstance(held, DataFrame):
            held = self._tables[name] = held()
        return held

    def on_days(self, fact: str, keys: Collection[int] | None) -> DataFrame:
        """The rows of a fact on days given by their date keys; all rows for none."""
        if keys is None:
            return self.table(fact)
        if fact in self._narrow:
            return self._narrow[fact](keys)
        return self.table(fact).filter(F.col("date_key").isin(*keys))

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> Star:
        narrow = {t: f for t, f in self._narrow.items() if t not in tables}
        return Star(self.snapshots, narrow, **{**self._tables, **tables})

    @contextmanager
    def kept(self) -> Iterator[Star]:
        """A star whose daily aggregates are computed once and kept.

        For many questions about the same snapshot.  What is kept has a row per
        day and stage, however large the facts are; the facts are never kept.
        """
        star = Star(self.snapshots, self._narrow, **self._tables)
        star._kept = {}
        try:
            yield star
        finally:
            for frame in star._kept.values():
                frame.unpersist()

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
        """The kept aggregate of that name, or nothing if this star keeps none."""
        if self._kept is None:
            return None
        if name not in self._kept:
            self._kept[name] = build().persist()
        return self._kept[name]

    @property
    def spark(self) -> SparkSession:
        return self.dim_date.sparkSession

    @property
    def dim_date(self) -> DataFrame:
        return self.table("dim_date")

    @property
    def dim_customer(self) -> DataFrame:
        return self.table("dim_customer")

    @property
    def dim_channel(self) -> DataFrame:
        return self.table("dim_channel")

    @property
    def dim_product(self) -> DataFrame:
        return self.table("dim_product")

    @property
    def fact_funnel_event(self) -> DataFrame:
        return self.table("fact_funnel_event")

    @property
    def fact_orders(self) -> DataFrame:
        return self.table("fact_orders")
