"""Payloom: capability-schema composition, resolution, validation and linting over Spark DataFrames."""

__version__ = "0.1.0"
