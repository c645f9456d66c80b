"""The order in which files would be read, as one number per row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits reserved for the place of a row inside its file.
ROW_DIGITS = 26


def reading_order(file_ord: Column, row_ord: Column, is_end: Column | int = 0) -> Column:
    """File by file; within a file all ``is_end`` 0 rows come before the others."""
    end = is_end if isinstance(is_end, Column) else F.lit(is_end)
    pass_ord = (file_ord.cast("long") * 2 + end).cast("decimal(11,0)")
    place = pass_ord * F.lit(Decimal(10**ROW_DIGITS)) + row_ord.cast(f"decimal({ROW_DIGITS},0)")
    return place.cast("decimal(37,0)")
