"""Spatial hazard-risk analytics as PySpark DataFrame operators."""

from hazardspark.session import configure, session

__all__ = ["configure", "session"]
