"""Ribostrand: paired-read reactivity analysis on PySpark.

Reads become rows, classification and counting become joins, aggregates and
windows, profiles become columns. See README.md.
"""

from .config import RunConfig

__all__ = ["RunConfig"]
