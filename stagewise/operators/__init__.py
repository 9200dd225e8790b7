"""Metric operators: one function per question, each answer with its provenance."""
