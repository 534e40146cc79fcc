"""Column expressions shared by the operators. They stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(x: Column, size: int) -> Column:
    """floor(x / size) of a whole number."""
    return F.floor(x / F.lit(float(size))).cast("long")


def mean(total: str, n: str) -> Column:
    """Mean of whole numbers, rounded half away from zero."""
    return F.round(F.col(total) / F.col(n)).cast("long")


def finite(*columns: str) -> Column:
    """True where no coordinate is null, NaN or infinite."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in columns))


def squared(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in columns))


def valid_normal(x: str, y: str, z: str, one: int) -> Column:
    """Squared length between 0.25 and 2.25; null and NaN are not valid."""
    return F.coalesce(squared(x, y, z).between(one * one // 4, one * one * 9 // 4), F.lit(False))


def first_and_last(p: Column, radius: int, step: int) -> tuple[Column, Column]:
    """The multiples of step within radius of p: from ceil((p - radius) / step) to floor((p + radius) / step)."""
    return F.ceil((p - radius) / F.lit(float(step))).cast("long"), F.floor((p + radius) / F.lit(float(step))).cast("long")


def offsets(low: int, high: int, *names: str) -> list[Column]:
    """One explode of all combinations low..high, as separate columns."""
    grid: list[tuple[int, ...]] = [()]
    for _ in names:
        grid = [(*g, i) for g in grid for i in range(low, high + 1)]
    return [F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names, g, strict=True))) for g in grid]
