"""Numeric expressions: null tokens, scaling, rounding, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripgrid.config import CELL_M, EARTH_CIRCUMFERENCE_M, NULL_TOKENS


def blank_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NULL_TOKENS), text)


def to_double(text: Column) -> Column:
    """Number, or null when the text is not one."""
    return text.try_cast("double")


def zscore(x: Column, mean: Column, spread: Column) -> Column:
    """Null when the spread is zero."""
    return F.try_divide(x - mean, spread)


def minmax(v: Column, lo: Column, hi: Column) -> Column:
    return F.try_divide((v - lo).cast("double"), (hi - lo).cast("double"))


def inv_minmax(v: Column, lo: Column, hi: Column) -> Column:
    """Back to counts, halves to even."""
    return F.rint(v * (hi - lo) + lo)


def round_pred(v: Column) -> Column:
    """Halves to even."""
    return F.rint(v)


def grid_cell(
    lat: Column,
    lon: Column,
    lat0: Column,
    lon0: Column,
    cell_m: int = CELL_M,
    circumference_m: int = EARTH_CIRCUMFERENCE_M,
) -> tuple[Column, Column]:
    """Cell of a point, counted from the box corner on a locally flat earth."""
    metres_per_turn = F.lit(float(circumference_m))
    side = F.lit(float(cell_m))
    shrink = F.cos((lat0 + lat) * F.lit(math.pi) / F.lit(360.0))
    east = (lon - lon0) * metres_per_turn * shrink / F.lit(360.0)
    north = (lat - lat0) * metres_per_turn / F.lit(360.0)
    return (east / side).cast("int"), (north / side).cast("int")
