"""Shared logical plans: daily aggregates, governed views, the query catalogue."""
