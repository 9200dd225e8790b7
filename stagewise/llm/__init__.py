"""Operators for text corpora at scale.  Nothing else in the package imports this folder."""
