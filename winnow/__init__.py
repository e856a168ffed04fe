"""Spark operators for preparing, auditing, selecting and weighing recommendation data."""

__version__ = "0.1.0"
