"""Operators for preparing large text corpora.

Nothing else in the library imports this package; it only builds on public Spark APIs.
"""
