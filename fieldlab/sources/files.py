"""Text outputs: CSV fields, VTK, STL and OBJ meshes, time collections.

Bodies are made in Spark as ordered lines (section, position, text) and written by one
ordered text write; with ``parts`` > 1 the body stays in as many ordered files.  Headers hold
counts only.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mesh

LINES = "section int, at long, text string"


def scientific(c: Column) -> Column:
    """Ten digits after the point, as the CSV format has them."""
    return F.format_string("%.10e", c.cast("double"))


def write_csv(df: DataFrame, path: str, order: list[str], delimiter: str = ",", parts: int | None = 1) -> None:
    """Rows in order with a header; doubles in scientific notation.  ``parts=None`` leaves the
    number of ordered files to the size of the data, so that no task sorts a fixed share of it."""
    rows = df.repartitionByRange(*(() if parts is None else (parts,)), *order).sortWithinPartitions(*order)
    shown = rows.select(*(scientific(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    shown.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", delimiter).schema(schema).csv(path)


def time_series(rows: DataFrame, time: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One row a time, one column a variable."""
    return rows.groupBy(time).pivot(name, names).agg(F.first(value)).orderBy(time)


def write_lines(lines: DataFrame, path: str, parts: int = 1) -> None:
    """Lines in order of section and position."""
    lines.repartitionByRange(parts, "section", "at").sortWithinPartitions("section", "at").select("text").write.mode("overwrite").text(path)


def read_lines(path: str) -> list[str]:
    """The lines of a written folder on a local disk, for tests and small files."""
    return [x.rstrip("\n") for f in sorted(glob.glob(os.path.join(path, "part-*"))) for x in open(f)]


def header(spark: SparkSession, section: int, *texts: str) -> DataFrame:
    """Lines of a section in the order given."""
    return spark.createDataFrame([(section, k, t) for k, t in enumerate(texts)], LINES)


def _number(c: Column) -> Column:
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def vtk_grid(field: DataFrame, shape: tuple[int, ...], spacing: tuple[float, ...], name: str = "u", title: str = "field") -> DataFrame:
    """Lines of a legacy structured-points file; field has i[, j[, k]] and v, and the first
    index varies fastest."""
    spark = field.sparkSession
    dims, h = (*shape, 1, 1)[:3], (*spacing, 1.0, 1.0)[:3]
    n = dims[0] * dims[1] * dims[2]
    place = F.col("i").cast("long")
    if "j" in field.columns:
        place = place + F.col("j") * dims[0]
    if "k" in field.columns:
        place = place + F.col("k") * dims[0] * dims[1]
    head = header(spark, 0, "# vtk DataFile Version 3.0", title, "ASCII", "DATASET STRUCTURED_POINTS", "DIMENSIONS {} {} {}".format(*dims), "ORIGIN 0 0 0", "SPACING {:g} {:g} {:g}".format(*h), f"POINT_DATA {n}", f"SCALARS {name} double 1", "LOOKUP_TABLE default")
    return head.union(field.select(F.lit(1).alias("section"), place.alias("at"), _number(F.col("v")).alias("text")))


def _dense(nodes: DataFrame) -> DataFrame:
    """nodes with ``d``: ranks from 0 in order of id, by ranges, whatever the ids."""
    rows = nodes.withColumn("_r", F.expr("id div 4096"))
    before = rows.groupBy("_r").agg(F.count("*").alias("_c"))
    before = before.select("_r", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(before, "_r").withColumn("d", F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("id")) - 1).drop("_r", "_b")


def _cells(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = elements.select("id", F.posexplode("node_ids").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "d"), "node")
    found = ids.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("c"))
    return elements.join(found, "id").select("id", "type", "tag", F.transform("c", lambda s: s["d"]).alias("c"))


def vtk_mesh(nodes: DataFrame, elements: DataFrame, title: str = "mesh") -> DataFrame:
    """Lines of a legacy unstructured grid with cell types and physical tags."""
    spark = nodes.sparkSession
    dense = _dense(nodes)
    cells = _cells(elements, dense)
    n, (m, size) = nodes.count(), cells.agg(F.count("*"), F.coalesce(F.sum(F.size("c") + 1), F.lit(0))).first()
    key = F.col("id").alias("at")
    parts = [
        header(spark, 0, "# vtk DataFile Version 3.0", title, "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"),
        dense.select(F.lit(1).alias("section"), F.col("d").alias("at"), F.concat_ws(" ", *(_number(F.col(a)) for a in "xyz")).alias("text")),
        header(spark, 2, f"CELLS {m} {size}"),
        cells.select(F.lit(3).alias("section"), key, F.concat_ws(" ", F.size("c").cast("string"), F.array_join(F.col("c").cast("array<string>"), " ")).alias("text")),
        header(spark, 4, f"CELL_TYPES {m}"),
        cells.select(F.lit(5).alias("section"), key, mesh.vtk_code(F.col("type")).cast("string").alias("text")),
        header(spark, 6, f"CELL_DATA {m}", "SCALARS physical_tag int 1", "LOOKUP_TABLE default"),
        cells.select(F.lit(7).alias("section"), key, F.col("tag").cast("string").alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def stl(nodes: DataFrame, elements: DataFrame, name: str = "mesh") -> DataFrame:
    """Lines of an ASCII STL: one facet with its unit normal for each triangle."""
    spark = nodes.sparkSession
    rows = mesh.normal(mesh.corners(elements, nodes))
    vertex = lambda k: F.concat_ws(" ", F.lit("    vertex"), *(_number(F.element_at("c", k)[a]) for a in "xyz"))
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("facet normal"), *(_number(F.col(f"n{a}")) for a in "xyz")), F.lit("  outer loop"), vertex(1), vertex(2), vertex(3), F.lit("  endloop"), F.lit("endfacet"))
    return header(spark, 0, f"solid {name}").union(rows.select(F.lit(1).alias("section"), F.col("id").alias("at"), text.alias("text"))).union(header(spark, 2, f"endsolid {name}"))


def obj(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines of an OBJ file: vertices, then triangles and quads by 1-based ranks."""
    dense = _dense(nodes)
    faces = _cells(elements.where("type in ('triangle', 'quad')"), dense)
    v = dense.select(F.lit(0).alias("section"), F.col("d").alias("at"), F.concat_ws(" ", F.lit("v"), *(_number(F.col(a)) for a in "xyz")).alias("text"))
    return v.union(faces.select(F.lit(1).alias("section"), F.col("id").alias("at"), F.concat(F.lit("f "), F.array_join(F.transform("c", lambda x: (x + 1).cast("string")), " ")).alias("text")))


EXPORTS = {"vtk": vtk_mesh, "stl": stl, "obj": obj}


def export(nodes: DataFrame, elements: DataFrame, path: str, kind: str) -> None:
    """Write a mesh as vtk, stl or obj; other formats are an error."""
    if kind not in EXPORTS:
        raise ValueError(f"no export to {kind}")
    write_lines(EXPORTS[kind](nodes, elements), path)


def pvd(times: list[tuple[float, str]]) -> str:
    """A collection file that names one data file a time."""
    body = "".join(f'    <DataSet timestep="{t:g}" group="" part="0" file="{f}"/>\n' for t, f in times)
    return f'<?xml version="1.0"?>\n<VTKFile type="Collection" version="0.1">\n  <Collection>\n{body}  </Collection>\n</VTKFile>\n'


def write_checkpoint(df: DataFrame, path: str, step: int, time: float) -> None:
    """State as Parquet under ``step=N`` with a row of metadata beside it."""
    df.write.mode("overwrite").parquet(f"{path}/step={step}")
    df.sparkSession.createDataFrame([(step, time)], "step long, time double").write.mode("overwrite").parquet(f"{path}/meta/step={step}")


def read_checkpoint(spark: SparkSession, path: str, step: int) -> tuple[DataFrame, float]:
    return spark.read.parquet(f"{path}/step={step}"), spark.read.parquet(f"{path}/meta/step={step}").first().time


def write_npz(path: str, **arrays) -> None:
    """Named arrays, or one-column DataFrames in order of their rows' ``i``, to one .npz file;
    arrays are small by nature of the format, larger fields belong in Parquet."""
    import numpy as np

    np.savez(path, **{k: np.array([r[0] for r in v.orderBy("i").select("v").collect()]) if isinstance(v, DataFrame) else np.asarray(v) for k, v in arrays.items()})


def read_npz(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(i, v) of one named array, flattened in row-major order."""
    import numpy as np

    with np.load(path) as f:
        values = f[name].ravel().astype(float)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i long, v double")
