import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import mesh
from fieldlab.sources import configs, files, gmsh, vtu

from .test_operators import tetra


def written(nodes, elements, folder):
    files.write_lines(gmsh.lines(nodes, elements), str(folder))
    return "\n".join(files.read_lines(str(folder))) + "\n"


def plain(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_gmsh_round_trip(spark, tmp_path):
    nodes, elements = tetra(spark)
    good = elements.where("id <= 3")
    path = tmp_path / "a.msh"
    text = written(nodes, good, tmp_path / "lines").replace("$Nodes", '$PhysicalNames\n1\n2 1 "wall"\n$EndPhysicalNames\n$Nodes', 1)
    path.write_text(text)
    for split in (1 << 20, 7, 1):
        nd, el, groups = gmsh.read(spark, str(path), split)
        assert plain(nd, "id", "x", "y", "z") == plain(nodes, "id", "x", "y", "z")
        assert plain(el, "id", "type", "node_ids", "tag") == plain(good, "id", "type", "node_ids", "tag")
        assert [(r.dimension, r.tag, r.name) for r in groups.collect()] == [(2, 1, "wall")]
    # windows line ends, blank lines, no line end at the end
    path.write_bytes(text.replace("\n", "\r\n").replace("$EndNodes", "\r\n$EndNodes").rstrip().encode())
    assert plain(gmsh.read(spark, str(path), 11)[0], "id", "x") == plain(nodes, "id", "x")
    for bad in (text.replace("2.2 0 8", "2.2 1 8"), text.replace("2.2 0 8", "5.1 0 8"), text.replace("$EndNodes\n", ""), "no mesh", ""):
        path.write_text(bad)
        with pytest.raises(Exception, match="version|has no end"):
            gmsh.read(spark, str(path), 16)


def test_gmsh_folder_in_many_ranges(spark, tmp_path, monkeypatch):
    nodes = spark.range(1, 3001).select("id", (F.col("id") / 7).alias("x"), (-F.col("id") / 3).alias("y"), F.lit(0.0).alias("z"))
    elements = spark.range(1, 2001).select("id", F.lit("triangle").alias("type"), F.array("id", F.col("id") + 1, F.col("id") + 2).alias("node_ids"), F.lit(4).alias("tag"))
    text = written(nodes, elements, tmp_path / "lines")
    for name in ("a.msh", "b.msh", "c.txt"):
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(gmsh, "BLOCK", 1000)
    nd, el, groups = gmsh.read(spark, str(tmp_path), 5000)
    assert nd.rdd.getNumPartitions() > 20
    assert plain(nd.where(F.col("file").endswith("b.msh")), "id", "x", "y", "z") == plain(nodes, "id", "x", "y", "z")
    assert el.count() == 4000 and el.select("id", "file").distinct().count() == 4000 and groups.count() == 0


def test_mesh_exports(spark, tmp_path):
    nodes, elements = tetra(spark)
    good = elements.where("id <= 3")
    for kind in ("vtk", "stl", "obj"):
        files.export(nodes, good, str(tmp_path / kind), kind)
    vtk = files.read_lines(str(tmp_path / "vtk"))
    assert vtk[4:6] == ["POINTS 4 double", "0 0 0"] and "CELLS 3 12" in vtk and vtk[vtk.index("CELLS 3 12") + 1] == "3 0 1 2"
    assert vtk[vtk.index("CELL_TYPES 3") + 1 :][:3] == ["5", "10", "3"] and vtk[-3:] == ["1", "1", "2"]
    stl = files.read_lines(str(tmp_path / "stl"))
    assert stl[0] == "solid mesh" and stl[1] == "facet normal 0 0 1" and stl[-1] == "endsolid mesh"
    assert files.read_lines(str(tmp_path / "obj"))[-1] == "f 1 2 3"
    with pytest.raises(ValueError):
        files.export(nodes, good, str(tmp_path / "ply"), "ply")


def test_fields(spark, tmp_path):
    grid = spark.range(6).select((F.col("id") % 3).alias("i"), F.floor(F.col("id") / 3).alias("j"), (F.col("id") * 1.5).alias("v"))
    files.write_lines(files.vtk_grid(grid, (3, 2), (0.1, 0.2)), str(tmp_path / "g"), parts=2)
    lines = files.read_lines(str(tmp_path / "g"))
    assert lines[4] == "DIMENSIONS 3 2 1" and lines[-6:] == ["0", "1.5", "3", "4.5", "6", "7.5"]
    files.write_csv(grid, str(tmp_path / "csv"), ["i", "j"])
    back = files.read_csv(spark, str(tmp_path / "csv"), "i long, j long, v double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid.collect()))
    files.write_checkpoint(grid, str(tmp_path / "c"), 3, 0.25)
    state, time = files.read_checkpoint(spark, str(tmp_path / "c"), 3)
    assert time == 0.25 and state.count() == 6
    assert 'timestep="0.5"' in files.pvd([(0.0, "a.vtk"), (0.5, "b.vtk")])
    long = spark.createDataFrame([(0.0, "A", 1.0), (0.0, "B", 2.0), (1.0, "A", 3.0)], "t double, s string, c double")
    assert [tuple(r) for r in files.time_series(long, "t", "s", "c").collect()] == [(0.0, 1.0, 2.0), (1.0, 3.0, None)]


def test_arrays(spark, tmp_path):
    field = spark.createDataFrame([(1, 2.5), (0, 1.5)], "i long, v double")
    files.write_npz(str(tmp_path / "a.npz"), u=field, w=[[1, 2], [3, 4]])
    assert [r.v for r in files.read_npz(spark, str(tmp_path / "a.npz"), "u").orderBy("i").collect()] == [1.5, 2.5]
    assert files.read_npz(spark, str(tmp_path / "a.npz"), "w").count() == 4


def grid_of(spark, path):
    return {r.id: (r.type, r.tag, [tuple(p) for p in r.points]) for r in spark.read.format("vtu").load(str(path)).collect()}


@pytest.mark.parametrize("encoding", ["binary", "ascii"])
def test_vtu_pieces(spark, tmp_path, encoding):
    spark.dataSource.register(vtu.Vtu)
    nodes, elements = tetra(spark)
    cells = vtu.with_points(elements.where("id <= 3"), nodes).withColumn("tag", F.when(F.col("id") < 3, F.col("tag"))).repartition(5, "id")
    want = {r.id: (r.type, r.tag or 0, [tuple(p) for p in r.points]) for r in cells.collect()}
    to = tmp_path / "grid"
    cells.write.format("vtu").option("encoding", encoding).mode("overwrite").save(str(to))
    names = {p.name for p in to.iterdir()}
    assert "index.pvtu" in names and len(names) <= 4 and grid_of(spark, to) == want
    piece = ET.parse(next(to.glob("piece-*"))).getroot().find(".//Piece")
    assert int(piece.get("NumberOfCells")) >= 1 and {a.get("Name") for a in piece.iter("DataArray")} == {"Points", "connectivity", "offsets", "types", "node", "id", "tag"}
    # append names more pieces, overwrite leaves none of the old ones
    more = cells.withColumn("id", F.col("id") + 100)
    more.write.format("vtu").option("encoding", encoding).mode("append").save(str(to))
    assert set(grid_of(spark, to)) == set(want) | {k + 100 for k in want}
    more.coalesce(1).write.format("vtu").mode("overwrite").save(str(to))
    assert set(grid_of(spark, to)) == {k + 100 for k in want} and len(list(to.iterdir())) == 2
    more.where("id < 0").write.format("vtu").mode("overwrite").save(str(to))
    assert grid_of(spark, to) == {} and len(list(to.iterdir())) == 1


def test_vtu_write_that_fails(spark, tmp_path):
    spark.dataSource.register(vtu.Vtu)
    nodes, elements = tetra(spark)
    cells = vtu.with_points(elements.where("id <= 3"), nodes)
    bad = cells.withColumn("type", F.when(F.col("id") == 3, "nonsense").otherwise(F.col("type"))).repartitionByRange(3, "id")
    for before in (None, 3):
        to = tmp_path / f"grid{before}"
        if before:
            cells.write.format("vtu").mode("overwrite").save(str(to))
        stood = sorted(p.name for p in to.iterdir()) if to.exists() else []
        with pytest.raises(Exception, match="nonsense"):
            bad.write.format("vtu").mode("overwrite").save(str(to))
        assert (sorted(p.name for p in to.iterdir()) if to.exists() else []) == stood
        assert not before or len(grid_of(spark, to)) == before
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("vtu").load(str(tmp_path / "nowhere")).count()


INI = "name = test # note\nbad line\n[solver]\ntype = implicit\ntolerance=1e-6\n[time]\nsteps = 10\nok = yes\n"


def test_configs(spark, tmp_path):
    values, problems = configs.read_ini(INI)
    assert values["solver.tolerance"] == "1e-6" and values["name"] == "test" and len(problems) == 1
    path = tmp_path / "a.ini"
    path.write_text(INI)
    assert configs.load(str(path)) == {"name": "test", "solver.type": "implicit", "solver.tolerance": 1e-6, "time.steps": 10, "time.ok": True}
    assert {r.key: r.value for r in configs.ini_table(spark, str(path)).collect()} == values
    for kind in ("json", "yaml"):
        configs.save({"a.b": 1, "a.c": [1, 2], "d": "x"}, str(tmp_path / f"f.{kind}"))
        assert configs.load(str(tmp_path / f"f.{kind}")) == {"a.b": 1, "a.c": [1, 2], "d": "x"}
    assert configs.from_environment("APP_", {"APP_SOLVER_TYPE": "x", "APP_N": "[1, 2.5]", "OTHER": "1"}) == {"solver.type": "x", "n": [1, 2.5]}
    assert mesh.TYPES["hex"][2] == 5
