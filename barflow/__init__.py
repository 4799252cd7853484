"""barflow: market-style time series analytics as Spark jobs."""

from barflow.config import Rules

__all__ = ["Rules"]
