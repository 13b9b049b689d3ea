"""Columns by their exact name, dots included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    return F.col(f"`{name}`")
