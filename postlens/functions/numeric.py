"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(c: Column, digits: int = 2) -> Column:
    """Round like Python's ``round(x, n)`` on doubles (nearest to the binary value).

    ``F.round`` rounds the shortest decimal string of the double, so 39.675
    (stored as 39.67499...) becomes 39.68; Python gives 39.67. Scaling first
    and rounding to an integer follows the binary value, as Python and DuckDB do.
    Exact binary ties (0.125) round half away from zero.
    """
    scale = float(10 ** digits)
    return F.round(c * scale, 0) / scale
