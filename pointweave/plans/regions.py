"""Tables of a mesher's state: parts that are written once, each partitioned by region, a cube of REGION blocks a side.

A step reads the regions around its dirty blocks only: the box of regions that each part keeps in the manifest says which parts are
opened at all, and the names of the regions prune the folders of these. So what a step reads does not grow with what lies elsewhere.
Regions go by space, so that a region's rows are bounded however many segments there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cell
from ..operators.incremental import BLOCK

REGION = 8
#: Regions that a read names; where there are more, its rows are joined with the table of regions.
NAMED = 4096

Part = dict[str, Any]  # part: its number, rows: how many it has, box: [first, last region] on each axis


def name(regions: list[Column]) -> Column:
    return F.concat_ws("_", *(r.cast("string") for r in regions))


@dataclass(frozen=True)
class Chosen:
    """Regions to read: all of them as a table (region), their box, and their names unless there are over NAMED."""

    table: DataFrame
    box: list[tuple[int, int]]
    names: list[str] | None

    def meets(self, part: Part) -> bool:
        return len(self.box) == 3 and all(a <= z and y <= b for (a, b), (y, z) in zip(self.box, part["box"], strict=True))


def around(blocks: DataFrame) -> Chosen:
    """The regions of blocks (bx, by, bz) and of their neighbours."""
    out = blocks.select(*BLOCK)
    for a in "xyz":
        out = out.withColumn(f"r{a}", F.explode(F.array_distinct(F.array(*(cell(F.col(f"b{a}") + d, REGION) for d in (-1, 0, 1))))))
    axes = [F.col(f"r{a}") for a in "xyz"]
    out = out.select(*axes).distinct()
    found = out.limit(NAMED + 1).collect()
    table = out.select(name(axes).alias("region"))
    if len(found) <= NAMED:
        return Chosen(table, [(min(v), max(v)) for v in zip(*found, strict=True)], ["_".join(map(str, r)) for r in found])
    box = out.agg(*(f(c) for c in axes for f in (F.min, F.max))).first()
    return Chosen(table, [(box[i], box[i + 1]) for i in (0, 2, 4)], None)


class Table:
    """<folder>/part=<number>/region=<x>_<y>_<z>/"""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def write(self, rows: DataFrame, number: int, block: dict[str, Column]) -> Part:
        """block: the block of a row by its columns. A part of the same number, left by a step that failed, is replaced."""
        part = f"{number:08d}"
        named = rows.withColumn("region", name([cell(block[b], REGION) for b in BLOCK]))
        named.hint("rebalance", "region").write.mode("overwrite").partitionBy("region").parquet(f"{self.folder}/part={part}")
        axes = [F.split("region", "_")[i].cast("long") for i in range(3)]
        found = self._open([part]).agg(F.count("*"), *(f(a) for a in axes for f in (F.min, F.max))).first()
        return {"part": part, "rows": found[0], "box": [[found[i], found[i + 1]] for i in (1, 3, 5)]}

    def _open(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part string, region string").option("basePath", self.folder).parquet(*(f"{self.folder}/part={p}" for p in parts))

    def read(self, parts: list[Part], chosen: Chosen | None = None) -> DataFrame:
        """Rows of parts, those in the chosen regions only."""
        there = [p["part"] for p in parts if p["rows"] and (chosen is None or chosen.meets(p))]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        rows = self._open(there)
        if chosen is not None:
            rows = rows.where(F.col("region").isin(chosen.names)) if chosen.names is not None else rows.join(chosen.table, "region", "left_semi")
        return rows.drop("part", "region")
