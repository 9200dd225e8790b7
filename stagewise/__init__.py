"""stagewise: staged-funnel analytics written as ordinary Spark DataFrames."""

from stagewise.errors import LedgerError, MetricError
from stagewise.session import build_session, use_utc, workspace
from stagewise.star import Star

__all__ = ["LedgerError", "MetricError", "Star", "build_session", "use_utc", "workspace"]
