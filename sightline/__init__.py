"""Sightline: a Spark-first engine for frame-ordered visual data and descriptor vectors."""

__version__ = "0.1.0"
