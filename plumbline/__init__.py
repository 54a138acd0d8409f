"""Data-quality and data-governance operators as plain Spark DataFrame functions."""

__version__ = "0.1.0"
