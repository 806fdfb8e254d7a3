"""Unstructured meshes: nodes(id, x, y, z, tag), elements(id, type, node_ids, tag).

Geometry joins each element's corner positions to nodes once (an equi-join on node id) and
gathers the corners back in order by element id, so everything after is row-wise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Corners, dimension, Gmsh code and VTK code of each element type.
TYPES = {"vertex": (1, 0, 15, 1), "line": (2, 1, 1, 3), "triangle": (3, 2, 2, 5), "quad": (4, 2, 3, 9), "tet": (4, 3, 4, 10), "hex": (8, 3, 5, 12), "prism": (6, 3, 6, 13), "pyramid": (5, 3, 7, 14)}


def _lookup(kind: Column, place: int) -> Column:
    out = F.lit(None).cast("int")
    for name, values in TYPES.items():
        out = F.when(kind == name, values[place]).otherwise(out)
    return out


def corner_count(kind: Column) -> Column:
    return _lookup(kind, 0)


def dimension(kind: Column) -> Column:
    return _lookup(kind, 1)


def gmsh_code(kind: Column) -> Column:
    return _lookup(kind, 2)


def vtk_code(kind: Column) -> Column:
    return _lookup(kind, 3)


def from_gmsh_code(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, values in TYPES.items():
        out = F.when(code == values[2], name).otherwise(out)
    return out


def valid(elements: DataFrame) -> DataFrame:
    """elements with ``valid``: as many nodes as the type has corners."""
    return elements.withColumn("valid", F.coalesce(F.size("node_ids") == corner_count(F.col("type")), F.lit(False)))


def dangling(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node): references to nodes that don't exist."""
    return elements.select("id", F.explode("node_ids").alias("node")).join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("id", "node")


def corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """elements with ``c``: the corners as structs (x, y, z) in the elements' order; elements
    that lack a node are left out."""
    rows = elements.select("id", F.posexplode("node_ids").alias("pos", "node"))
    rows = rows.join(nodes.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    found = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda s: F.struct(s["x"], s["y"], s["z"])).alias("c"))
    return elements.join(found, "id").where(F.size("c") == F.size("node_ids"))


def _minus(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]


def _cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def _norm(u) -> Column:
    return F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])


def distance(a: Column, b: Column) -> Column:
    return _norm(_minus(a, b))


def _at(k: int) -> Column:
    return F.try_element_at("c", F.lit(k + 1))


def _triangle_area(a: Column, b: Column, c: Column) -> Column:
    return 0.5 * _norm(_cross(_minus(b, a), _minus(c, a)))


def _determinant() -> Column:
    u, v, w = (_minus(_at(k), _at(0)) for k in (1, 2, 3))
    n = _cross(v, w)
    return u[0] * n[0] + u[1] * n[1] + u[2] * n[2]


def measure(rows: DataFrame) -> DataFrame:
    """corner rows with ``measure``: length, area, volume; hexahedra by their bounding box;
    prisms, pyramids and vertices 0."""
    kind = F.col("type")
    spread = lambda a: F.array_max(F.transform("c", lambda s: s[a])) - F.array_min(F.transform("c", lambda s: s[a]))
    value = F.when(kind == "line", distance(_at(0), _at(1))).when(kind == "triangle", _triangle_area(_at(0), _at(1), _at(2))).when(kind == "quad", _triangle_area(_at(0), _at(1), _at(2)) + _triangle_area(_at(0), _at(2), _at(3))).when(kind == "tet", F.abs(_determinant()) / 6.0).when(kind == "hex", spread("x") * spread("y") * spread("z")).otherwise(F.lit(0.0))
    return rows.withColumn("measure", F.coalesce(value, F.lit(0.0)))


def centroid(rows: DataFrame) -> DataFrame:
    """corner rows with cx, cy, cz."""
    mean = lambda a: F.aggregate(F.transform("c", lambda s: s[a]), F.lit(0.0), lambda x, y: x + y) / F.size("c")
    return rows.withColumns({f"c{a}": mean(a) for a in "xyz"})


def normal(rows: DataFrame) -> DataFrame:
    """Triangles with unit normals (nx, ny, nz); degenerate ones get 0."""
    n = _cross(_minus(_at(1), _at(0)), _minus(_at(2), _at(0)))
    size = _norm(n)
    return rows.where("type = 'triangle'").withColumns({f"n{a}": F.when(size > 1e-12, n[k] / F.when(size > 1e-12, size)).otherwise(F.lit(0.0)) for k, a in enumerate("xyz")})


def _clamped_angle(x: Column) -> Column:
    return F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def _triangle_quality(l1: Column, l2: Column, l3: Column) -> dict[str, Column]:
    most, least = F.greatest(l1, l2, l3), F.least(l1, l2, l3)
    s = (l1 + l2 + l3) / 2.0
    area = F.sqrt(F.greatest(F.lit(0.0), s * (s - l1) * (s - l2) * (s - l3)))
    good = area > 1e-12
    angle = lambda p, q, opposite: F.when(good, _clamped_angle((p * p + q * q - opposite * opposite) / F.when(good, 2 * p * q))) * 180.0 / math.pi
    angles = [angle(l1, l3, l2), angle(l1, l2, l3), angle(l2, l3, l1)]
    skew = F.greatest(*(F.abs(x - 60.0) / 60.0 for x in angles))
    return {"aspect": F.when(least > 1e-12, most / F.when(least > 1e-12, least)).otherwise(F.lit(1000.0)), "volume": area, "skewness": F.coalesce(skew, F.lit(0.0)), "min_angle": F.coalesce(F.least(*angles), F.lit(0.0)), "max_angle": F.coalesce(F.greatest(*angles), F.lit(0.0))}


def quality(rows: DataFrame) -> DataFrame:
    """corner rows with aspect, volume, skewness, min_angle and max_angle of triangles, quads
    and tetrahedra; other types are left out."""
    # edge lengths become columns first: nested, they would make code too large to compile
    rows = rows.where(F.col("type").isin("triangle", "quad", "tet")).withColumns({f"_e{a}{b}": distance(_at(a), _at(b)) for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))})
    e = lambda a, b: F.col(f"_e{min(a, b)}{max(a, b)}")
    tri, other = _triangle_quality(e(0, 1), e(1, 2), e(2, 0)), _triangle_quality(e(0, 2), e(2, 3), e(3, 0))
    ratio = lambda ls: F.when(F.least(*ls) > 1e-12, F.greatest(*ls) / F.when(F.least(*ls) > 1e-12, F.least(*ls))).otherwise(F.lit(1000.0))
    quad = {"aspect": ratio([e(k, (k + 1) % 4) for k in range(4)]), "volume": tri["volume"] + other["volume"], "skewness": F.greatest(tri["skewness"], other["skewness"]), "min_angle": F.lit(0.0), "max_angle": F.lit(0.0)}
    edges = [e(a, b) for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    mean = sum(edges[1:], start=edges[0]) / 6.0
    ideal = mean * mean * mean / (6.0 * math.sqrt(2.0))
    volume = F.abs(_determinant()) / 6.0
    tet = {"aspect": ratio(edges), "volume": volume, "skewness": F.when(ideal > 1e-12, F.abs(volume - ideal) / F.when(ideal > 1e-12, ideal)).otherwise(F.lit(0.0)), "min_angle": F.lit(0.0), "max_angle": F.lit(0.0)}
    kind = F.col("type")
    return rows.withColumns({k: F.when(kind == "triangle", tri[k]).when(kind == "quad", quad[k]).otherwise(tet[k]) for k in tri}).drop(*(f"_e{a}{b}" for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))))


def quality_report(rows: DataFrame) -> DataFrame:
    """One row over quality rows: degenerate elements counted apart, ranges and means of the
    others, and a score of 0 to 100."""
    good = F.col("volume") >= 1e-12
    v = lambda c: F.when(good, F.col(c))
    angled = F.when(good & (F.col("min_angle") > 0), F.col("min_angle")), F.when(good & (F.col("min_angle") > 0), F.col("max_angle"))
    out = rows.agg(F.count_if(~good).alias("degenerate"), F.count_if(good).alias("n"), F.min(v("aspect")).alias("min_aspect"), F.max(v("aspect")).alias("max_aspect"), F.avg(v("aspect")).alias("avg_aspect"), F.min(v("skewness")).alias("min_skewness"), F.max(v("skewness")).alias("max_skewness"), F.avg(v("skewness")).alias("avg_skewness"), F.min(angled[0]).alias("min_angle"), F.max(angled[1]).alias("max_angle"))
    shape = F.greatest(F.lit(0.0), 100.0 - (F.col("avg_aspect") - 1.0) * 20.0)
    skew = F.greatest(F.lit(0.0), 100.0 - F.col("avg_skewness") * 100.0)
    angle = F.when((F.col("min_angle") > 20.0) & (F.col("max_angle") < 140.0), 100.0).otherwise(50.0)
    return out.withColumn("score", (shape + skew + angle) / 3.0)


def statistics(rows: DataFrame) -> DataFrame:
    """One row over measured rows: counts by type; least, greatest, mean positive measure."""
    some = F.when(F.col("measure") > 0, F.col("measure"))
    return rows.agg(F.count("*").alias("n"), *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES), F.min(some).alias("min_measure"), F.max(some).alias("max_measure"), F.avg(some).alias("avg_measure"))


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def edges(elements: DataFrame) -> DataFrame:
    """(a, b): the undirected edges between cyclically successive corners, once each."""
    n = F.size("node_ids")
    pairs = F.transform(F.col("node_ids"), lambda x, k: F.struct(x.alias("p"), F.element_at("node_ids", (k + 1) % n + 1).alias("q")))
    rows = elements.select(F.explode(pairs).alias("e")).where("e.p <> e.q")
    return rows.select(F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b")).distinct()


def neighbours(elements: DataFrame) -> DataFrame:
    """(node, other): nodes that share an element, each pair in both directions."""
    rows = elements.select("id", F.explode("node_ids").alias("node"))
    return rows.join(rows.select("id", F.col("node").alias("other")), "id").where("node <> other").select("node", "other").distinct()


def refine(elements: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles cut into four at their edges' midpoints: (elements, nodes).

    Midpoint ids follow the largest node id in order of edges: ranks within hash-free ranges
    of the first end, plus the count of edges in the ranges before, so no global sort window
    is needed.
    """
    tri = elements.where("type = 'triangle'")
    mid = edges(tri).withColumn("range", F.expr("a div 1024"))
    sizes = mid.groupBy("range").agg(F.count("*").alias("c"))
    sizes = sizes.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    last = nodes.agg(F.max("id").alias("last"))
    mid = mid.join(sizes, "range").crossJoin(F.broadcast(last)).withColumn("m", F.col("last") + F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("a", "b"))).select("a", "b", "m")
    position = lambda k: nodes.select(F.col("id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz"))
    new_nodes = mid.join(position("a"), "a").join(position("b"), "b").select(F.col("m").alias("id"), *(((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"), F.lit(0).alias("tag"))
    rows = tri.select("id", "tag", *(F.element_at("node_ids", k + 1).alias(f"n{k}") for k in range(3)))
    for k in range(3):
        p, q = f"n{k}", f"n{(k + 1) % 3}"
        rows = rows.join(mid.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("m").alias(f"m{k}")), (F.least(p, q) == F.col("_a")) & (F.greatest(p, q) == F.col("_b"))).drop("_a", "_b")
    ids = lambda *names: F.array(*names)
    children = F.array(ids("n0", "m0", "m2"), ids("m0", "n1", "m1"), ids("m2", "m1", "n2"), ids("m0", "m1", "m2"))
    new_elements = rows.select("id", "tag", F.posexplode(children).alias("k", "node_ids")).select((F.col("id") * 4 + F.col("k")).alias("id"), F.lit("triangle").alias("type"), "node_ids", "tag")
    return new_elements, nodes.select("id", "x", "y", "z", "tag").union(new_nodes)


def smooth(elements: DataFrame, nodes: DataFrame, weight: float = 0.5) -> DataFrame:
    """One Laplacian sweep: nodes moved ``weight`` of the way to their neighbours' mean."""
    near = neighbours(elements).join(nodes.select(F.col("id").alias("other"), "x", "y", "z"), "other")
    mean = near.groupBy(F.col("node").alias("id")).agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    out = nodes.join(mean, "id", "left")
    return out.select("id", *((F.col(a) + weight * (F.coalesce(f"m{a}", a) - F.col(a))).alias(a) for a in "xyz"), "tag")


def rectangle(spark, nx: int, ny: int, width: float = 1.0, height: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of nx by ny quads over a rectangle, ids from 0."""
    k = spark.range((nx + 1) * (ny + 1))
    i, j = F.col("id") % (nx + 1), F.expr(f"id div {nx + 1}")
    nodes = k.select("id", (i * width / nx).alias("x"), (j * height / ny).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("tag"))
    e = spark.range(nx * ny)
    corner = F.expr(f"id div {nx}") * (nx + 1) + F.col("id") % nx
    elements = e.select("id", F.lit("quad").alias("type"), F.array(corner, corner + 1, corner + nx + 2, corner + nx + 1).alias("node_ids"), F.lit(0).alias("tag"))
    return nodes, elements


def decompose(elements: DataFrame, parts: int, total: int) -> DataFrame:
    """elements with ``part``: chunks of ceil(total / parts) in order of id, by ranks within
    ranges of ids."""
    size = -(-total // parts)
    rows = elements.withColumn("_r", F.expr("id div 4096"))
    before = rows.groupBy("_r").agg(F.count("*").alias("_c"))
    before = before.select("_r", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("id"))
    return rows.join(before, "_r").withColumn("part", F.floor((rank - 1) / size).cast("int")).drop("_r", "_b")


def interface_nodes(parts: DataFrame) -> DataFrame:
    """(a, b, node): nodes that two parts share, a < b."""
    rows = parts.select("part", F.explode("node_ids").alias("node")).distinct()
    return rows.select(F.col("part").alias("a"), "node").join(rows.select(F.col("part").alias("b"), "node"), "node").where("a < b").select("a", "b", "node")


def overlaps(parts: DataFrame) -> DataFrame:
    """(a, b, shared): how many nodes neighbouring parts share."""
    return interface_nodes(parts).groupBy("a", "b").agg(F.count("*").alias("shared"))


# --------------------------------------------------------------- adaptive cells


def gradient_error(cells: DataFrame) -> DataFrame:
    """cells(id, x, y, size, level, v) with ``error``: the largest |dv| / distance to a cell
    whose centre lies nearer than twice the size.  A range join: cells meet by squares of
    their own size's double, never all with all."""
    near = F.explode(F.array(*(F.struct((F.floor(F.col("x") / (2 * F.col("s"))) + i).alias("bx"), (F.floor(F.col("y") / (2 * F.col("s"))) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sizes = cells.select(F.col("size").alias("s")).distinct()  # one for each level
    asked = cells.withColumn("s", F.col("size")).select("id", "x", "y", "v", "s", near.alias("b")).select("id", "x", "y", "v", "s", "b.*")
    found = cells.crossJoin(F.broadcast(sizes)).select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("v").alias("ov"), "s", F.floor(F.col("x") / (2 * F.col("s"))).alias("bx"), F.floor(F.col("y") / (2 * F.col("s"))).alias("by"))
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    # sizes are judged before explode makes nine rows of each, so Spark would broadcast all cells
    pairs = asked.join(found.hint("merge"), ["s", "bx", "by"]).where((F.col("id") != F.col("o")) & (d < 2 * F.col("s")) & (d > 0))
    error = pairs.groupBy("id").agg(F.max(F.abs(F.col("v") - F.col("ov")) / d).alias("error"))
    return cells.join(error.hint("merge"), "id", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))


def mark(cells: DataFrame, refine_at: float = 0.75, coarsen_at: float = 0.1, most: int = 3) -> DataFrame:
    """cells with ``mark``: refine, coarsen or keep, by share of the largest error."""
    top = cells.agg(F.max("error").alias("_m"))
    rows = cells.crossJoin(F.broadcast(top))
    return rows.withColumn("mark", F.when((F.col("error") > refine_at * F.col("_m")) & (F.col("level") < most), "refine").when((F.col("error") < coarsen_at * F.col("_m")) & (F.col("level") > 0), "coarsen").otherwise("keep")).drop("_m")


def adapt(cells: DataFrame) -> DataFrame:
    """Marked cells refined into four; four siblings that all coarsen merge into their mean."""
    base = ["id", "x", "y", "size", "level", "v"]
    quarter = F.col("size") / 4
    child = F.explode(F.array(*(F.struct((F.col("id") * 4 + k).alias("id"), (F.col("x") + sx * quarter).alias("x"), (F.col("y") + sy * quarter).alias("y")) for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (-1, 1), (1, 1)))))).alias("c")
    finer = cells.where("mark = 'refine'").select(child, "size", "level", "v").select("c.id", "c.x", "c.y", (F.col("size") / 2).alias("size"), (F.col("level") + 1).alias("level"), "v")
    w = Window.partitionBy(F.expr("id div 4"), "level")
    rows = cells.where("mark <> 'refine'").withColumn("_m", F.count_if(F.col("mark") == "coarsen").over(w) == 4)
    merged = rows.where("_m").groupBy(F.expr("id div 4").alias("id"), "level").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), (2 * F.max("size")).alias("size"), F.avg("v").alias("v")).select("id", "x", "y", "size", (F.col("level") - 1).alias("level"), "v")
    return rows.where("not _m").select(*base).union(finer).union(merged)
