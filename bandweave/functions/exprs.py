"""Column expressions: exact integer buckets, saturating bounds, band and window predicates, rows as text.

All are built-in expressions, so they stay within generated code. Integer keys are exact over the whole range of 64 bits;
decimal keys (unsigned 64-bit values) take part through the same functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def long_lit(value: int) -> Column:
    return F.lit(value).cast("bigint") if value > LONG_MIN else (F.lit(value + 1).cast("bigint") - F.lit(1).cast("bigint"))


def fdiv(key: Column, width: int) -> Column:
    """floor(key / width) for integers, without going through doubles."""
    w = long_lit(width)
    return F.call_function("div", key, w) - F.when(key % w < 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def sat_sub(key: Column, by: int) -> Column:
    """key - by, or the least 64-bit integer."""
    return F.coalesce(F.try_subtract(key, long_lit(by)), F.when(key.isNotNull(), long_lit(LONG_MIN)))


def sat_add(key: Column, by: int) -> Column:
    """key + by, or the greatest 64-bit integer."""
    return F.coalesce(F.try_add(key, long_lit(by)), F.when(key.isNotNull(), long_lit(LONG_MAX)))


def in_range(value: Column, centre: Column, by: int) -> Column:
    """Whether value lies in [centre - by, centre + by], at the ends too, without overflow."""
    return value.between(sat_sub(centre, by), sat_add(centre, by))


def in_band(one: Column, two: Column, band: int | float) -> Column:
    """|one - two| <= band. Integers are compared with saturating bounds, other numbers by their difference."""
    return in_range(one, two, band) if isinstance(band, int) else F.abs(one - two) <= F.lit(band)


def copies(key: Column, by: int, width: int) -> Column:
    """All buckets of the width that hold a key within by of this one."""
    return F.sequence(fdiv(sat_sub(key, by), width), fdiv(sat_add(key, by), width))


def as_side(df: DataFrame, ts: str | Column, key: str | Column, value: str | Column | None = None, keep: bool = False) -> DataFrame:
    """df as one side of a join: columns ts, key and value (default: the key), and its own ones too if they are kept."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    three = [col(ts).alias("ts"), col(key).alias("key"), (col(key) if value is None else col(value)).alias("value")]
    return df.select(*three, *([c for c in df.columns if c not in ("ts", "key", "value")] if keep else []))


def short_text(ts: str = "ts", key: str = "key", side: str = "side") -> Column:
    """A row as T(ts,key,side)."""
    return F.format_string("T(%s,%s,%s)", F.col(ts).cast("string"), F.col(key).cast("string"), F.col(side))


def long_text(ts: str = "ts", key: str = "key", side: str = "side") -> Column:
    """A row as (ts=…, key=…, side)."""
    return F.format_string("(ts=%s, key=%s, %s)", F.col(ts).cast("string"), F.col(key).cast("string"), F.col(side))


def full_text(ts: str = "ts", key: str = "key", value: str = "value", side: str = "side") -> Column:
    """A row as (ts = …, key = …, value = …, side)."""
    return F.format_string("(ts = %s, key = %s, value = %s, %s)", F.col(ts).cast("string"), F.col(key).cast("string"), F.col(value).cast("string"), F.coalesce(F.col(side), F.lit("UNKNOWN")))


def pair_text(left: Column, right: Column) -> Column:
    """Two rows as text, R first."""
    return F.format_string("%s | %s", left, right)
