"""Scalar and aggregate expressions whose answers differ from Spark's own, as Column helpers.

All are compositions of built-in expressions, so they stay inside Catalyst and code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def avg_int(name: str) -> Column:
    """Average of an integer column, truncated toward zero; null over no values."""
    return F.expr(f"sum(`{name}`) div nullif(count(`{name}`), 0)")


def length_bytes(x: Column | str) -> Column:
    """Length of a text in UTF-8 bytes."""
    return F.octet_length(_col(x)).cast("bigint")


def concat_all(*xs: Column | str) -> Column:
    """Concatenation; null if any part is."""
    return F.concat(*[_col(x) for x in xs])


def trim_all(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(x), _BOUNDARY_SPACE, "")


def left_n(x: Column | str, n: int) -> Column:
    return F.left(_col(x), F.lit(max(n, 0)))


def right_n(x: Column | str, n: int) -> Column:
    return F.right(_col(x), F.lit(max(n, 0)))


def substring_clamped(x: Column | str, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 counts as 1 and leaves the length as it is."""
    return F.substring(_col(x), max(start, 1), (1 << 31) - 1 if length is None else max(length, 0))


def keep_kind(f, x: Column, whole: bool) -> Column:
    """A rounding function that gives an integer for an integer argument and a double for a double."""
    return f(x).cast("bigint" if whole else "double")


def mod_or_null(a: Column | str, b: Column | str) -> Column:
    """Remainder of the whole parts; null where the divisor is 0."""
    return F.try_mod(_col(a).cast("bigint"), _col(b).cast("bigint"))


def extract_part(part: str, ts: Column | str) -> Column:
    """A field of a timestamp; Sunday is day 0 of the week. Null for a field that isn't known."""
    ts = _col(ts)
    fields = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "dow": lambda t: F.dayofweek(t) - 1, "doy": F.dayofyear,
    }
    if part == "epoch":
        return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
    return fields[part](ts).cast("bigint") if part in fields else F.lit(None).cast("bigint")


def date_trunc_ntz(part: str, ts: Column | str) -> Column:
    """Start of the period, weeks on Monday, without a time zone. Null for a period that isn't known."""
    if part not in ("year", "month", "week", "day", "hour", "minute", "second"):
        return F.lit(None).cast("timestamp_ntz")
    return F.date_trunc(part, _col(ts)).cast("timestamp_ntz")


def cast_or_null(x: Column | str, kind: str) -> Column:
    """CAST that gives null where a value can't be converted; text with a fraction becomes its whole part."""
    x, kind = _col(x), kind.lower()
    if kind in ("int", "integer", "bigint"):
        text = x.cast("string")
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))
    if kind in ("float", "real", "double", "numeric", "decimal"):
        return x.try_cast("double")
    if kind in ("text", "varchar", "char"):
        return x.cast("string")
    if kind in ("bool", "boolean"):
        return F.when(x.isNotNull(), F.upper(x.cast("string")).isin("TRUE", "1"))
    if kind == "date":
        return F.date_trunc("day", x.try_cast("timestamp_ntz")).cast("timestamp_ntz")
    if kind in ("timestamp", "datetime"):
        return x.try_cast("timestamp_ntz")
    return F.lit(None).cast("string")


def json_path(x: Column | str, *keys: str) -> Column:
    """The value under a chain of object keys, as text; null if it is missing, null, or the text is no JSON."""
    return F.get_json_object(_col(x), "$" + "".join(f"['{k}']" for k in keys))
