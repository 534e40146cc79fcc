"""Point files as a Spark data source: a task reads a range of records, and filters on seg and level choose the files.

    spark.dataSource.register(PointFiles)
    spark.read.format("pointfiles").option("layout", "segments").load(folder).where("seg = 3 and level = 1")

Files are listed where partitions are planned, by names and lengths only: each task reads the header of its own file. With
spark.sql.python.filterPushdown.enabled (option pushdown says so to the source), what a filter excludes is never opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import ply

SCHEMA = "seg int, level int, ord long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float"
#: Rows of a batch that a task hands over.
BATCH = 65_536
#: Every so many records of a chunk are its preview.
THIN = 4
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Range(InputPartition):
    """Records first, first + 1, .. of a file, RANGE at most, those whose place is a multiple of stride."""

    path: str
    seg: int
    level: int
    first: int
    stride: int
    normals: bool


@dataclass(frozen=True)
class PointFile:
    path: str
    length: int
    seg: int
    level: int
    stride: int = 1
    normals: bool = True


def listed(folder: str) -> list[tuple[str, str, int]]:
    """(name, path with scheme, length) of the files in a folder, by name."""
    where, at = ply._at(folder)
    base = folder.rstrip("/")
    found = [f for f in where.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File]
    return sorted((f.base_name, f"{base}/{f.base_name}", f.size) for f in found)


def segment_files(folder: str) -> list[PointFile]:
    """r<k>_refined.ply and r<k>_preview_new.ply, k = 0, 1, .. up to the first gap; FileNotFoundError for a refined file without its preview."""
    have, out, k = {name: (path, length) for name, path, length in listed(folder)}, [], 0
    while (refined := f"r{k}_refined.ply") in have:
        if (preview := f"r{k}_preview_new.ply") not in have:
            raise FileNotFoundError(preview)
        out += [PointFile(*have[preview], k, 0), PointFile(*have[refined], k, 1)]
        k += 1
    return out


def chunk_files(folder: str) -> list[PointFile]:
    """tc_*.ply by name: each is a refined segment and, thinned and without normals, its preview."""
    chunks = [(path, length) for name, path, length in listed(folder) if re.fullmatch(r"tc_.*\.ply", name)]
    return [f for k, (path, length) in enumerate(chunks) for f in (PointFile(path, length, k, 0, THIN, False), PointFile(path, length, k, 1))]


LAYOUTS = {"segments": segment_files, "chunks": chunk_files}


class PointReader(DataSourceReader):
    def __init__(self, folder: str, layout: str, stride: int):
        self.folder, self.layout, self.stride = folder, layout, stride
        self.only: dict[str, set[int]] = {}

    def files(self) -> list[PointFile]:
        return [f for f in LAYOUTS[self.layout](self.folder) if all(getattr(f, c) in v for c, v in self.only.items())]

    def partitions(self) -> list[Range]:
        # a file's length bounds its records; ranges beyond the last record are empty
        out = []
        for f in self.files():
            stride = f.stride * self.stride if f.stride == 1 or self.stride == 1 else int(np.lcm(f.stride, self.stride))
            firsts = range(0, max(f.length // ply.RECORD.itemsize, 1), ply.RANGE)
            out += [Range(f.path, f.seg, f.level, first, stride, f.normals) for first in firsts if -first % stride < ply.RANGE]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads once even where there are no partitions
            return
        p, (where, at) = partition, ply._at(partition.path)
        with where.open_input_file(at) as f:
            length = f.size()
            body, n = ply.header(ply._head(f, length), length)
            skip = -p.first % p.stride
            last = min(p.first + ply.RANGE, n)
            # a batch at a time: with a stride of S, BATCH rows span S times as many records
            step = max(p.stride, BATCH // p.stride * p.stride)
            for a in range(p.first + skip, last, step):
                rows = np.frombuffer(f.read_at((min(a + step, last) - a) * ply.RECORD.itemsize, body + a * ply.RECORD.itemsize), ply.RECORD)[:: p.stride]
                columns = [pa.array(np.full(len(rows), v, np.int32)) for v in (p.seg, p.level)]
                columns.append(pa.array(a + np.arange(len(rows), dtype=np.int64) * p.stride))
                for c in ply.RECORD.names:
                    v = np.ascontiguousarray(rows[c])
                    columns.append(pa.array(v.astype(np.int16) if c in "rgb" else v.astype(np.float32) if p.normals or c in "xyz" else np.full(len(rows), np.nan, np.float32)))
                yield pa.RecordBatch.from_arrays(columns, ["seg", "level", "ord", *ply.RECORD.names])


class PushingReader(PointReader):
    """Takes equality and membership of seg and level; Spark applies all other filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in ("seg", "level"):
                self.only[column] = self.only.get(column, set(values)) & set(values)
            else:
                yield f


class PointFiles(DataSource):
    """Options: path, layout ("segments" or "chunks"), stride (records 0, stride, .. only), pushdown ("true" or "false")."""

    @classmethod
    def name(cls) -> str:
        return "pointfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        layout, stride = self.options.get("layout", "segments"), int(self.options.get("stride", 1))
        if layout not in LAYOUTS or stride <= 0:
            raise ValueError("layout is segments or chunks, stride is positive")
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else PointReader
        return kind(self.options["path"], layout, stride)


def read(spark: SparkSession, folder: str, layout: str = "segments", stride: int = 1) -> DataFrame:
    """SCHEMA rows of a folder's points. Files are listed here once too, so that a missing one is told at once."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    LAYOUTS[layout](folder)
    spark.dataSource.register(PointFiles)
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("pointfiles").option("layout", layout).option("stride", stride).option("pushdown", pushdown).load(folder)
