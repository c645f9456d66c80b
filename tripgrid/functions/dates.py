"""Date and hour-bucket expressions. All of them assume a UTC session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripgrid.config import HOUR_OFFSET_S, HOUR_S, OD_ORIGIN

# Fixed values: %-codes and the pattern letters that parse the same text. One letter
# accepts one or two digits, as the %-codes do.
_CODES = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s"}


def spark_pattern(fmt: str, padded: bool = False) -> str:
    """Datetime pattern for a %-code format; ``padded`` prints two digits."""
    out, quoted, i = [], "", 0

    def flush() -> None:
        nonlocal quoted
        if quoted:
            plain = all(not c.isalpha() and c != "'" for c in quoted)
            out.append(quoted if plain else "'" + quoted.replace("'", "''") + "'")
            quoted = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            letter = _CODES.get(fmt[i + 1])
            if letter is None:
                raise ValueError(f"unsupported date code %{fmt[i + 1]}")
            flush()
            out.append(letter * 2 if padded and len(letter) == 1 else letter)
            i += 2
        else:
            quoted += fmt[i]
            i += 1
    flush()
    return "".join(out)


def split_date(text: Column) -> Column:
    """First whitespace-separated token."""
    return F.get(F.split(F.trim(text), r"\s+"), F.lit(0))


def join_date_time(date: Column | None, time: Column) -> Column:
    """``date`` + ``T`` + ``time``; without a date the time text is already complete."""
    return time if date is None else F.concat(date, F.lit("T"), time)


def parse_ts(text: Column, fmt: str) -> Column:
    """Timestamp by one %-code format; null when the text does not match."""
    return F.try_to_timestamp(text, F.lit(spark_pattern(fmt)))


def parse_ts_by(text: Column, key: Column, formats: Mapping[str, str]) -> Column:
    """Timestamp by the format of the row's set (one branch per distinct format)."""
    names_of: dict[str, list[str]] = {}
    for name, fmt in formats.items():
        names_of.setdefault(fmt, []).append(name)
    branches = [F.when(key.isin(names), parse_ts(text, fmt)) for fmt, names in names_of.items()]
    return F.coalesce(*branches)


def parse_ts_multi(text: Column) -> Column:
    """Timestamp by the look of the text: a dash means year first, colons add a clock.

    The text picks a single format, so each row is parsed once.
    """
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))

    def clocked(day: str) -> Column:
        return (
            F.when(colons == 0, parse_ts(text, day))
            .when(colons == 1, parse_ts(text, day + " %H:%M"))
            .otherwise(parse_ts(text, day + " %H:%M:%S"))
        )

    return F.when(F.contains(text, F.lit("-")), clocked("%Y-%m-%d")).otherwise(clocked("%m/%d/%Y"))


def is_valid_ts(text: Column, fmt: str) -> Column:
    return parse_ts(text, fmt).isNotNull()


def hour_tag(ts: Column, step_s: int = HOUR_S, offset_s: int = HOUR_OFFSET_S) -> Column:
    """Bucket number since ``offset_s``, cut toward zero."""
    shifted = F.unix_seconds(ts) - F.lit(offset_s).cast("long")
    return F.call_function("div", shifted, F.lit(step_s).cast("long"))


def origin_seconds(origin: str = OD_ORIGIN) -> Column:
    return F.unix_seconds(F.lit(origin).cast("timestamp"))


def hour_tag_origin(ts: Column, origin: str = OD_ORIGIN, step_s: int = HOUR_S) -> Column:
    """Bucket number since ``origin``, floored: earlier times get negative numbers."""
    since = F.unix_seconds(ts) - origin_seconds(origin)
    return F.floor(since / F.lit(step_s)).cast("long")


def tag_to_ts(tag: Column, step_s: int = HOUR_S, offset_s: int | Column = HOUR_OFFSET_S) -> Column:
    """First instant of a bucket; the inverse of both tag functions."""
    offset = offset_s if isinstance(offset_s, Column) else F.lit(offset_s).cast("long")
    return F.timestamp_seconds(tag * F.lit(step_s).cast("long") + offset)


def hour_interval(tag: Column, step_s: int = HOUR_S, offset_s: int | Column = HOUR_OFFSET_S) -> tuple[Column, Column]:
    """Start of the bucket and start of the next one."""
    return tag_to_ts(tag, step_s, offset_s), tag_to_ts(tag + 1, step_s, offset_s)
