"""Dense numbers by an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], order: list[str], cut: Callable[[DataFrame], DataFrame], name: str = "idx") -> DataFrame:
    """rows with a number (long) from 0 within each group, in the given order; a null group value is a group.

    Rows are sorted into ranges, so a large group spans many of them. A row's number is its place in its range less that of the
    group's first row there, plus the group's rows in the ranges before; these sums have a row for each range and group.
    cut keeps the ranges, so that both uses of them agree. Rows that tie in all of order stand in any order.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = cut(ranged.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")))
    parts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    parts = parts.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), base.alias("_base"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(parts, same).select(*rows.columns, (F.col("_place") + F.col("_base")).alias(name))
