"""Gmsh ASCII meshes (version 2 layout, versions below 5 accepted), read by byte ranges.

A mesh file is one long text, so it is cut into ranges of ``split`` bytes that tasks read on
their own.  What a line means depends on the last ``$Section`` before it, so two Python data
sources share the work: ``gmsh_marks`` finds where the sections of every file begin and end (one
row a mark), and ``gmsh`` then reads only the ranges of one section and hands its lines to
Spark, which parses them.  A line belongs to the range in which it starts.  A task holds some
thousands of lines, whatever the file's size.

Binary files, versions outside [2, 5) and sections without an end are errors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import mesh
from .shared import listed, place

SPLIT = 32 << 20
#: Bytes read at once, and bytes at a file's beginning in which its format must be named.
BLOCK, HEAD = 1 << 20, 4096


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first: int


def _lines(root: str, part: Range) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of the lines that start in a range: (offset of the first, lines).  ``first`` is
    where the range's first line surely starts; any other range begins behind a line's end."""
    system, _ = place(root)
    with system.open_input_file(part.file) as f:
        at = part.start
        if at > part.first:
            # the line that the byte before stands in isn't ours
            at -= 1
            f.seek(at)
            while block := f.read(BLOCK):
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(block)
        f.seek(at)
        rest = b""
        while at < part.end:
            block = f.read(BLOCK)
            data = rest + block
            lines = data.split(b"\n")
            rest = lines.pop() if block else b""
            if lines:
                size, kept = 0, []
                for line in lines:
                    if at + size >= part.end:
                        break
                    kept.append(line)
                    size += len(line) + 1
                yield at, kept
                at = part.end if len(kept) < len(lines) else at + size
            if not block:
                return


def _ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, at, min(end, at + split), start) for at in range(start, end, split)]


class Marks(DataSource):
    """(file, at, next, mark): lines that begin with ``$``, where they and the next line start."""

    @classmethod
    def name(cls) -> str:
        return "gmsh_marks"

    def schema(self) -> str:
        return "file string, at long, next long, mark string"

    def reader(self, schema) -> MarksReader:
        return MarksReader(self.options)


class MarksReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.end = options["path"], int(options["split"]), options["end"]

    def partitions(self) -> list[Range]:
        system, path = place(self.path)
        out, files = [], listed(system, path, self.end)
        if not files:
            raise FileNotFoundError(f"{path}: no files that end in {self.end}")
        for info in files:
            with system.open_input_stream(info.path) as f:
                head = f.read(HEAD).split(b"\n")
            said = head[1].split() if len(head) > 1 and head[0].strip() == b"$MeshFormat" else []
            try:
                sound = 2 <= float(said[0]) < 5 and int(said[1]) == 0
            except (IndexError, ValueError):
                sound = False
            if not sound:
                raise ValueError(f"{info.path}: not an ASCII mesh of a version from 2 to below 5")
            out += _ranges(info.path, 0, info.size, self.split)
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, lines in _lines(self.path, partition):
            for line in lines:
                if line.startswith(b"$"):
                    yield partition.file, at, at + len(line) + 1, line.decode().strip()
                at += len(line) + 1


class Gmsh(DataSource):
    """(file, line): the lines between the given bounds of each file, empty ones left out."""

    @classmethod
    def name(cls) -> str:
        return "gmsh"

    def schema(self) -> str:
        return "file string, line string"

    def reader(self, schema) -> SectionReader:
        return SectionReader(self.options)


class SectionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.bounds = options["path"], int(options["split"]), json.loads(options["bounds"])

    def partitions(self) -> list[Range]:
        return [r for file, start, end in self.bounds for r in _ranges(file, start, end, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):  # a file without the section
            return
        for at, lines in _lines(self.path, partition):
            if at == partition.first:
                lines = lines[1:]  # how many there are
            text = [x.decode().strip() for x in lines if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(text)), pa.array(text, pa.string())], ["file", "line"])


def sections(spark: SparkSession, path: str, split: int = SPLIT, end: str = ".msh") -> dict[str, list[tuple[str, int, int]]]:
    """For each section the (file, start, end) of its lines; a few marks a file."""
    spark.dataSource.register(Marks)
    marks = spark.read.format("gmsh_marks").option("split", split).option("end", end).load(path).orderBy("file", "at").collect()
    out: dict[str, list[tuple[str, int, int]]] = {}
    begun = None
    for m in marks:
        if m.mark.startswith("$End"):
            if begun is None or (begun.file, "$End" + begun.mark[1:]) != (m.file, m.mark):
                raise ValueError(f"{m.file}: {m.mark} ends nothing")
            out.setdefault(begun.mark[1:], []).append((m.file, begun.next, m.at))
            begun = None
        elif begun is not None:
            raise ValueError(f"{begun.file}: {begun.mark} has no end")
        else:
            begun = m
    if begun is not None:
        raise ValueError(f"{begun.file}: {begun.mark} has no end")
    return out


def read(spark: SparkSession, path: str, split: int = SPLIT, end: str = ".msh") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, elements, physical groups) of a file, or of those of a folder whose names end so,
    each with ``file``; elements of unknown types are left out."""
    found = sections(spark, path, split, end)
    spark.dataSource.register(Gmsh)

    def lines(section: str) -> DataFrame:
        return spark.read.format("gmsh").option("split", split).option("bounds", json.dumps(found.get(section, []))).load(path)

    parts = F.split("line", r"\s+")
    at = lambda k: F.element_at("p", k)
    nodes = lines("Nodes").withColumn("p", parts).select("file", at(1).cast("long").alias("id"), *(at(k + 2).cast("double").alias(a) for k, a in enumerate("xyz")), F.lit(0).alias("tag"))
    tags = at(3).cast("int")
    ids = F.transform(F.slice("p", tags + 4, F.size("p")), lambda x: x.cast("long"))
    elements = lines("Elements").withColumn("p", parts).select("file", at(1).cast("long").alias("id"), mesh.from_gmsh_code(at(2).cast("int")).alias("type"), ids.alias("node_ids"), F.when(tags > 0, at(4).cast("int")).otherwise(0).alias("tag")).where("type is not null")
    groups = lines("PhysicalNames").withColumn("p", parts).select("file", at(1).cast("int").alias("dimension"), at(2).cast("int").alias("tag"), F.regexp_extract("line", '"([^"]*)"', 1).alias("name"))
    return nodes, elements, groups


def lines(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """The lines of a mesh file, for ``files.write_lines``; only the two counts are collected."""
    from .files import header

    spark = nodes.sparkSession
    n, m = nodes.count(), elements.count()
    shown = lambda *c: F.concat_ws(" ", *c)
    body = nodes.select(F.lit(1).alias("section"), F.col("id").alias("at"), shown("id", "x", "y", "z").alias("text"))
    cells = elements.select(F.lit(3).alias("section"), F.col("id").alias("at"), shown(F.col("id"), mesh.gmsh_code(F.col("type")), F.lit(2), F.col("tag"), F.col("tag"), F.array_join(F.col("node_ids").cast("array<string>"), " ")).alias("text"))
    out = header(spark, 0, "$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(n)).union(body)
    return out.union(header(spark, 2, "$EndNodes", "$Elements", str(m))).union(cells).union(header(spark, 4, "$EndElements"))
