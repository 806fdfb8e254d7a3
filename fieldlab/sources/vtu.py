"""Unstructured grids as VTU pieces under one PVTU index: the data source ``vtu``.

    spark.dataSource.register(Vtu)
    with_points(elements, nodes).write.format("vtu").mode("overwrite").save(path)
    spark.read.format("vtu").load(path)

Every task writes the cells of its partition and the points they touch as one piece; the driver
writes the index when all tasks are done, so a failed write leaves no index that names half of
the pieces, and what its tasks wrote is removed.  ``overwrite`` replaces a grid once the new
index stands; ``append`` names its pieces beside the old ones.  Reading is one task a piece.

Arrays are base64 blocks of little-endian values with 64-bit lengths (``encoding`` ``binary``,
exact and compact) or texts of 17 digits (``ascii``).  A task holds its partition's cells as
arrays, never as one text; partitions are the caller's to size.

Cases: a partition without cells writes no piece, a grid without any an index without pieces;
points that several pieces touch stand in each; a null tag is 0; unknown cell types are an error.
"""

from __future__ import annotations

import base64
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.mesh import TYPES
from .shared import listed, place, remove, whole

SCHEMA = "id long, type string, tag int, points array<struct<node:long,x:double,y:double,z:double>>"
INDEX = "index.pvtu"
KINDS = {"Float64": "<f8", "Int64": "<i8", "Int32": "<i4", "UInt8": "u1"}
CODE = {name: kind[3] for name, kind in TYPES.items()}
NAME = {code: name for name, code in CODE.items()}
#: Values that are turned into text at once.
STRETCH = 1 << 16


def with_points(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells with their corners: (id, type, tag, points); elements of missing nodes are left out."""
    corner = elements.select("id", "type", "tag", F.size("node_ids").alias("k"), F.posexplode("node_ids").alias("pos", "node"))
    rows = corner.join(nodes.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    found = rows.groupBy("id", "type", "tag", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "x", "y", "z"))).alias("c"))
    return found.where(F.size("c") == F.col("k")).select("id", "type", "tag", F.transform("c", lambda s: F.struct(*(s[f].cast(t).alias(f) for f, t in (("node", "long"), ("x", "double"), ("y", "double"), ("z", "double"))))).alias("points"))


def _array(out, name: str, kind: str, values: np.ndarray, encoding: str, width: int = 1) -> None:
    values = np.ascontiguousarray(values, KINDS[kind])
    parts = f' NumberOfComponents="{width}"' if width > 1 else ""
    out.write(f'<DataArray type="{kind}" Name="{name}"{parts} format="{encoding}">'.encode())
    if encoding == "binary":
        out.write(base64.b64encode(values.nbytes.to_bytes(8, "little")))
        raw, step = values.reshape(-1).view("u1"), 3 * STRETCH
        for at in range(0, len(raw), step):
            out.write(base64.b64encode(raw[at : at + step]))
    else:
        flat, digits = values.reshape(-1), "%.17g" if kind == "Float64" else "%d"
        for at in range(0, len(flat), STRETCH):
            out.write((" ".join(digits % v for v in flat[at : at + STRETCH].tolist()) + "\n").encode())
    out.write(b"</DataArray>\n")


def write_piece(out, batches: list[pa.RecordBatch], encoding: str) -> tuple[int, int]:
    """One piece of the cells of some batches; gives the numbers of points and cells."""
    table = pa.Table.from_batches(batches).combine_chunks()
    points = table.column("points").combine_chunks()
    corner, ends = points.flatten(), np.cumsum(pa.compute.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64))
    node, first, local = np.unique(corner.field("node").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    xyz = np.stack([corner.field(c).to_numpy(zero_copy_only=False)[first] for c in "xyz"], axis=1)
    kinds = [CODE[k] for k in table.column("type").to_pylist()]
    out.write(f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<UnstructuredGrid>\n<Piece NumberOfPoints="{len(node)}" NumberOfCells="{len(ends)}">\n<Points>\n'.encode())
    _array(out, "Points", "Float64", xyz, encoding, 3)
    out.write(b"</Points>\n<Cells>\n")
    _array(out, "connectivity", "Int64", local, encoding)
    _array(out, "offsets", "Int64", ends, encoding)
    _array(out, "types", "UInt8", np.array(kinds), encoding)
    out.write(b"</Cells>\n<PointData>\n")
    _array(out, "node", "Int64", node, encoding)
    out.write(b"</PointData>\n<CellData>\n")
    _array(out, "id", "Int64", table.column("id").to_numpy(), encoding)
    _array(out, "tag", "Int32", table.column("tag").fill_null(0).to_numpy(), encoding)
    out.write(b"</CellData>\n</Piece>\n</UnstructuredGrid>\n</VTKFile>\n")
    return len(node), len(ends)


def _values(node: ET.Element) -> np.ndarray:
    kind, text = KINDS[node.get("type")], node.text or ""
    if node.get("format") == "ascii":
        return np.array(text.split(), kind)
    text = text.strip()
    size = int.from_bytes(base64.b64decode(text[:12]), "little")
    return np.frombuffer(base64.b64decode(text[12:]), kind, size // np.dtype(kind).itemsize)


def read_piece(file) -> Iterator[pa.RecordBatch]:
    """The cells of one piece, some thousands at a time."""
    root = ET.parse(file).getroot()
    got = {a.get("Name"): _values(a) for a in root.iter("DataArray")}
    xyz, ends = got["Points"].reshape(-1, 3), got["offsets"]
    kinds = np.array([NAME[k] for k in got["types"].tolist()], object)
    for lo in range(0, len(ends), STRETCH):
        hi = min(len(ends), lo + STRETCH)
        start = ends[lo - 1] if lo else 0
        at = got["connectivity"][start : ends[hi - 1]]
        corner = pa.StructArray.from_arrays([pa.array(got["node"][at]), *(pa.array(xyz[at, k]) for k in range(3))], ["node", "x", "y", "z"])
        offsets = np.concatenate([[0], ends[lo:hi] - start]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(got["id"][lo:hi]), pa.array(kinds[lo:hi], pa.string()), pa.array(got["tag"][lo:hi]), pa.ListArray.from_arrays(pa.array(offsets), corner)], ["id", "type", "tag", "points"])


@dataclass
class Piece(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    points: int = 0
    cells: int = 0


def index(names: list[str]) -> bytes:
    """The index file over the pieces."""
    arrays = lambda tag, *of: f"<{tag}>" + "".join(f'<PDataArray type="{t}" Name="{n}"{w}/>' for t, n, w in of) + f"</{tag}>\n"
    body = arrays("PPoints", ("Float64", "Points", ' NumberOfComponents="3"')) + arrays("PPointData", ("Int64", "node", "")) + arrays("PCellData", ("Int64", "id", ""), ("Int32", "tag", ""))
    pieces = "".join(f'<Piece Source="{n}"/>\n' for n in names)
    return f'<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<PUnstructuredGrid GhostLevel="0">\n{body}{pieces}</PUnstructuredGrid>\n</VTKFile>\n'.encode()


def indexed(system, folder: str) -> list[str]:
    """The pieces that the index of a folder names, or none without an index."""
    try:
        with system.open_input_stream(f"{folder}/{INDEX}") as f:
            return [p.get("Source") for p in ET.parse(f).getroot().iter("Piece")]
    except FileNotFoundError:
        return []


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.encoding, self.job = options.get("encoding", "binary"), uuid.uuid4().hex
        if self.encoding not in ("binary", "ascii"):
            raise ValueError(f"unknown encoding {self.encoding}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        system, folder = place(self.path)
        system.create_dir(folder)
        name = f"piece-{self.job}-{uuid.uuid4().hex}.vtu"  # an attempt's own name
        with whole(system, f"{folder}/{name}") as out:
            return Written(name, *write_piece(out, batches, self.encoding))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = place(self.path)
        system.create_dir(folder)
        old = indexed(system, folder)
        new = sorted(m.name for m in messages if m and m.name)
        with whole(system, f"{folder}/{INDEX}") as out:
            out.write(index(new if self.overwrite else old + new))
        for name in old if self.overwrite else []:
            remove(system, f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = place(self.path)
        for m in messages:
            if m and m.name:
                remove(system, f"{folder}/{m.name}")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Piece]:
        system, folder = place(self.path)
        listed(system, folder)  # a missing folder is an error
        return [Piece(f"{folder}/{n}") for n in indexed(system, folder)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "path"):
            return
        system, _ = place(self.path)
        with system.open_input_stream(partition.path) as f:
            yield from read_piece(f)


class Vtu(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vtu"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)
