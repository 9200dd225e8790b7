"""Errors a caller is expected to handle."""


class MetricError(ValueError):
    """A question that was understood but has no answer in the data."""


class LedgerError(RuntimeError):
    """A versioned table, snapshot or moment that does not exist."""
