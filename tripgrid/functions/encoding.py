"""Array encodings used as model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(value: Column, values: Sequence) -> Column:
    """0/1 array over ``values``; a value outside the list is an error."""
    slots = F.transform(F.array(*[F.lit(v) for v in values]), lambda v: (v == value).cast("int"))
    return F.when(value.isin(*values), slots).otherwise(
        F.raise_error(F.concat(F.lit("value outside the one-hot list: "), F.coalesce(value.cast("string"), F.lit("null"))))
    )


def _unit_rows(size: int) -> Column:
    """Constant table whose row ``i`` is the one-hot array of position ``i``."""
    rows = [F.array(*[F.lit(float(i == j)) for j in range(size)]) for i in range(size)]
    return F.array(*rows)


def time_features(ts: Column) -> Column:
    """Weekday (Monday first, 7), month (12) and hour/23: twenty doubles."""
    weekday = F.get(_unit_rows(7), F.weekday(ts))
    month = F.get(_unit_rows(12), F.month(ts) - 1)
    return F.concat(weekday, month, F.array(F.hour(ts) / F.lit(23.0)))
