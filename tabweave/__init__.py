"""Queries, profiles and repairs of tabular files, on Spark."""

__version__ = "0.2.0"
