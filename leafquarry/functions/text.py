"""Text expressions with the white space and case rules of the text layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def holds(c: Column, needle: str | Column) -> Column:
    """Case-insensitive containment; the empty needle is in every text."""
    return F.contains(F.lower(c), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))
