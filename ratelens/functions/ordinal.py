"""Ordinal metrics as aggregate columns. Quadratic kappa needs five sums and no matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_CLASSES = 5


def _d(c: Column) -> Column:
    return c.cast("double")


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(_d(y) - _d(p)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((_d(y) - _d(p)) * (_d(y) - _d(p))))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(_d((y == p).cast("int")))


def off_by_one(y: Column, p: Column) -> Column:
    return F.avg(_d((F.abs(y - p) <= 1).cast("int")))


def qwk(y: Column, p: Column, where: Column | None = None) -> Column:
    """Quadratic weighted kappa over a fixed scale; null where it is undefined (one constant label)."""

    def total(c: Column) -> Column:
        c = c.cast("bigint")
        return _d(F.sum(c if where is None else F.when(where, c)))

    ok = y.isNotNull() & p.isNotNull()
    n = total(F.when(ok, 1))
    y, p = F.when(ok, y.cast("bigint")), F.when(ok, p.cast("bigint"))
    off = total((y - p) * (y - p))
    chance = total(y * y) + total(p * p) - 2.0 * total(y) * total(p) / n
    return 1.0 - off / F.nullif(chance, F.lit(0.0))


def metrics(y: Column, p: Column, digits: int = 9) -> list[Column]:
    named = {"mae": mae(y, p), "rmse": rmse(y, p), "accuracy": accuracy(y, p), "off_by_one": off_by_one(y, p), "qwk": qwk(y, p)}
    return [F.round(c, digits).alias(k) for k, c in named.items()]


def sql_qwk(y: str, p: str) -> str:
    y, p = f"{y}::BIGINT", f"{p}::BIGINT"
    s = lambda e: f"sum({e})::DOUBLE"
    return f"(1.0 - {s(f'({y}-{p})*({y}-{p})')} / nullif({s(f'{y}*{y}')} + {s(f'{p}*{p}')} - 2.0 * {s(y)} * {s(p)} / count(*)::DOUBLE, 0.0))"
