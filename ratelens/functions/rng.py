"""Randomness from hashes: the same for any partitioning, and computable by another engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(parts: tuple[Column | str | int, ...]) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def h(*parts: Column | str | int) -> Column:
    """The first 32 bits of the MD5 of the parts joined by bars, as a bigint."""
    return F.conv(F.substring(_digest(parts), 1, 8), 16, 10).cast("bigint")


def u01(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the first 52 bits."""
    return F.conv(F.substring(_digest(parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def order_key(*parts: Column | str | int) -> Column:
    """A value to shuffle by."""
    return _digest(parts)


def sql_h(*parts: str) -> str:
    """DuckDB twin of ``h`` for SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
