"""Binary PLY files: a point source that reads ranges of records, and writers for welded meshes, block files and step metrics.

Spark lists the files; tasks read ranges and write files through pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh

# The header that point files have, property by property, and the record's layout.
PROPERTIES = ["float x", "float y", "float z", "uchar red", "uchar green", "uchar blue", "float nx", "float ny", "float nz"]
RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4")])
#: Other names of the types.
ALIASES = {"float32": "float", "uint8": "uchar"}
#: Records that are read together, and bytes of a header that are read at once.
RANGE, HEAD = 1 << 20, 1 << 16
POINT_SCHEMA = "path string, ord long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float"


def header(raw: bytes, length: int | None = None) -> tuple[int, int]:
    """(place of the first record, number of records) from a file's first bytes and its length (that of raw, if not said).

    ValueError for any other kind of file, or a body that is too short; what follows the records is ignored.
    """
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply\n") or end < 0:
        raise ValueError("not a PLY file")
    lines = [x.split() for x in raw[:end].decode("ascii", "replace").split("\n")[1:]]
    lines = [x for x in lines if x and x[0] not in ("comment", "obj_info")]
    kinds = [x[1:2] for x in lines if x[0] == "format"]
    if kinds != [["binary_little_endian"]]:
        raise ValueError("only binary little-endian files are read")
    elements = [x for x in lines if x[0] == "element"]
    if len(elements) != 1 or elements[0][1:2] != ["vertex"] or len(elements[0]) != 3 or not elements[0][2].isdigit():
        raise ValueError("one vertex element is expected")
    if [" ".join([ALIASES.get(x[1], x[1]), *x[2:]]) for x in lines if x[0] == "property" and len(x) > 1] != PROPERTIES or any(x[0] not in ("format", "element", "property") for x in lines):
        raise ValueError("other properties than position, colour and normal")
    n, body = int(elements[0][2]), end + len(b"end_header\n")
    if (len(raw) if length is None else length) - body < n * RECORD.itemsize:
        raise ValueError("the body is shorter than the header says")
    return body, n


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _head(f: pa.NativeFile, length: int) -> bytes:
    """A file's first bytes, as far as its header goes; what is no header is not read on."""
    raw = b""
    while len(raw) < length and b"end_header\n" not in raw and raw[:4] in (b"", b"ply\n"):
        raw += f.read_at(min(max(HEAD, len(raw)), length - len(raw)), len(raw))
    return raw


def read_points(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """POINT_SCHEMA rows of all files that path matches; with a stride, records 0, stride, ... are the only ones given.

    A file is read in ranges of RANGE records, by different tasks.
    """
    if stride <= 0:
        raise ValueError("stride must be positive")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, at = _at(name)
                with where.open_input_file(at) as f:
                    body, n = header(_head(f, length), length)
                first = np.arange(0, n, RANGE)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first)), pa.array([body] * len(first), pa.int64()), pa.array(first, pa.int64()), pa.array(np.minimum(n - first, RANGE), pa.int64())], ["path", "body", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                where, at = _at(r["path"])
                with where.open_input_file(at) as f:
                    rows = np.frombuffer(f.read_at(r["n"] * RECORD.itemsize, r["body"] + r["first"] * RECORD.itemsize), RECORD)
                skip = -r["first"] % stride
                rows = rows[skip::stride]
                for a in range(0, len(rows), 65_536):
                    part = rows[a : a + 65_536]
                    cols = [pa.array([r["path"]] * len(part)), pa.array(r["first"] + skip + np.arange(a, a + len(part), dtype=np.int64) * stride)]
                    cols += [pa.array(np.ascontiguousarray(part[c]).astype(np.int16 if c in "rgb" else np.float32)) for c in RECORD.names]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "ord", *RECORD.names])

    found = spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(ranges, "path string, body long, first long, n long")
    return found.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, POINT_SCHEMA)


def steps(segs: list[int], order: str = "realistic") -> list[list[tuple[int, int]]]:
    """Steps of (seg, level): "pr" takes P0, R0, P1, R1, ..; "realistic" takes P0, (R0 and P1), .., R last."""
    if order == "pr":
        return [[(s, level)] for s in segs for level in (0, 1)]
    out = [[(segs[0], 0)]] if segs else []
    for a, b in zip(segs, segs[1:], strict=False):
        out.append([(a, 1), (b, 0)])
    return out + ([[(segs[-1], 1)]] if segs else [])


def write_points(path: str, rows: np.ndarray) -> None:
    """A point file from an array of RECORD."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *(f"property {p}" for p in PROPERTIES), "end_header", ""]
    with open(path, "wb") as f:
        f.write("\n".join(head).encode() + rows.astype(RECORD).tobytes())


def _mesh_header(vertices: int, faces: int) -> bytes:
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {vertices}", *(f"property {p}" for p in PROPERTIES[:6]), f"element face {faces}", "property list uchar int vertex_indices", "end_header", ""]).encode()


def write_mesh(meshes: DataFrame, path: str, cut: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
    """One PLY file of all blocks, welded: 15 bytes a vertex (metres), 13 a face; returns the numbers of vertices and faces.

    Tasks encode runs of vertices and faces; the driver appends them to the file one after the other.
    """

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros(b.num_rows, [("p", "<f4", 3), ("c", "u1", 3)])
            v["p"], v["c"] = (np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) for names in ("xyz", "rgb"))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], ["raw"])

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.zeros(b.num_rows, [("n", "u1"), ("i", "<i4", 3)])
            t["n"], t["i"] = 3, np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("i0", "i1", "i2")], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], ["raw"])

    corners = mesh.exploded(meshes)
    verts = cut(mesh.numbered(mesh.weld(corners), cut))
    tris = cut(mesh.welded_faces(meshes, corners, verts))
    n, m = verts.count(), tris.count()
    where, at = _at(path)
    with where.open_output_stream(at) as f:
        f.write(_mesh_header(n, m))
        for r in verts.orderBy("idx").select(*((F.col(a) / 1e6).alias(a) for a in "xyz"), "r", "g", "b").mapInArrow(vertices, "raw binary").toLocalIterator():
            f.write(r["raw"])
        for r in tris.orderBy(*mesh.BLOCK, "k").select("i0", "i1", "i2").mapInArrow(faces, "raw binary").toLocalIterator():
            f.write(r["raw"])
    return n, m


def block_bytes(block: tuple[int, int, int], version: int, positions: np.ndarray, colors: np.ndarray, indices: np.ndarray) -> bytes:
    """A block mesh record; a deleted block is an empty one with its current version."""
    n, t = len(positions) // 3, len(indices) // 3
    raw = np.asarray(colors, np.uint8).tobytes()
    return b"SLMB" + struct.pack("<I3i3I", 1, *block, version, n, t) + np.asarray(positions, "<f4").tobytes() + raw + bytes(-len(raw) % 4) + np.asarray(indices, "<u4").tobytes()


def block_records(meshes: DataFrame) -> DataFrame:
    """(bx, by, bz, version, record binary): block_bytes of every row of meshes with version, positions in metres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = [block_bytes((r["bx"], r["by"], r["bz"]), r["version"], np.array(r["positions"] or []) / 1e6, r["colors"] or [], r["indices"] or []) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in ("bx", "by", "bz", "version")), pa.array(out, pa.binary())], ["bx", "by", "bz", "version", "record"])

    return meshes.select("bx", "by", "bz", "version", "positions", "colors", "indices").mapInArrow(run, "bx long, by long, bz long, version long, record binary")


def write_blocks(changes: DataFrame, folder: str) -> int:
    """A file block_<x>_<y>_<z>.slmb for every row of block_records(changes), written by tasks; returns their number.

    A file appears under its name when it is complete, and one that is written again replaces the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = _at(folder)
        where.create_dir(at, recursive=True)
        for b in batches:
            for r in b.to_pylist():
                name = f"{at.rstrip('/')}/block_{r['bx']}_{r['by']}_{r['bz']}.slmb"
                with where.open_output_stream(f"{name}.{r['version']}.part") as f:
                    f.write(r["record"])
                where.move(f"{name}.{r['version']}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return block_records(changes).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_metrics(rows: DataFrame, path: str) -> None:
    """Step metrics as CSV with a header."""
    rows.write.mode("append").option("header", True).csv(path)
