"""Sparse and dense matrices as (i, j, v) rows, vectors as (i, x) rows.

Products are an equi-join and a partially aggregated sum; a batch key ``run`` may stand in
front of every index.  Iterative solvers place the matrix once (``Standing``) and keep one small
state table a product, written to shared storage so that lineage stays short.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def spmv(matrix: DataFrame, x: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """([keys], i, y) with y = A x; rows of A without entries give no row."""
    keys = keys or []
    return matrix.join(x.select(*keys, F.col("i").alias("j"), "x"), [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def matmul(a: DataFrame, b: DataFrame, keys: list[str] | None = None, n: int | None = None) -> DataFrame:
    """([keys], i, j, v) with v = A B; ``n`` partitions hold the entries and their products, or
    Spark's number without it."""
    keys = keys or []
    deal = lambda df, *by: df if n is None else df.repartition(n, *keys, *by)
    left = deal(a.select(*keys, "i", F.col("j").alias("k"), "v"), "k")
    right = deal(b.select(*keys, F.col("i").alias("k"), "j", F.col("v").alias("w")), "k")
    products = left.join(right, [*keys, "k"]).select(*keys, "i", "j", (F.col("v") * F.col("w")).alias("v"))
    return deal(products, "i", "j").groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _blocks(matrix: DataFrame, keys: list[str], rows: str, columns: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    """([keys], block row, block column, values): the matrix as dense blocks of ``size`` squared,
    values and a mask of the entries that are there, repeated entries summed."""
    bi, bj, out = names
    types = dict(matrix.dtypes)
    placed = matrix.select(*keys, F.floor(F.col(rows) / size).alias(bi), F.floor(F.col(columns) / size).alias(bj), F.pmod(rows, F.lit(size)).cast("int").alias("_i"), F.pmod(columns, F.lit(size)).cast("int").alias("_j"), F.col("v").cast("double").alias("_v"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros((2, size, size))
        at = table.column("_i").to_numpy(), table.column("_j").to_numpy()
        np.add.at(block[0], at, table.column("_v").to_numpy())
        block[1][at] = 1.0
        return pa.table({n: pa.array([k.as_py()], k.type) for n, k in zip([*keys, bi, bj], key, strict=True)} | {out: pa.array([block.tobytes()], pa.binary())})

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{bi} long", f"{bj} long", f"{out} binary"])
    return placed.groupBy(*keys, bi, bj).applyInArrow(pack, schema)


def matmul_blocked(a: DataFrame, b: DataFrame, keys: list[str] | None = None, size: int = 256) -> DataFrame:
    """([keys], i, j, v) with v = A B, by dense blocks: entries are packed into blocks of ``size``
    squared, blocks meet on their common index, and numpy multiplies and sums them.

    What is shuffled is one row a block and partner instead of one a product, so this is for
    matrices that aren't very sparse.  An entry comes out where some product stands behind it.
    A task holds one block's partners at a time.
    """
    keys = keys or []
    types = dict(a.dtypes)
    left = _blocks(a, keys, "i", "j", size, ("bi", "bk", "a"))
    right = _blocks(b, keys, "i", "j", size, ("bk", "bj", "b"))
    names = [*keys, "bi", "bj"]

    def multiply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                one, other = (np.frombuffer(z.as_buffer()).reshape(2, size, size) for z in (x, y))
                total += one @ other
        i, j = np.nonzero(total[1] > 0)
        at = {n: k.as_py() for n, k in zip(names, key, strict=True)}
        columns = [pa.array([at[k]] * len(i), batch.schema.field(k).type) for k in keys] if len(i) else [pa.array([], batch.schema.field(k).type) for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(i + at["bi"] * size), pa.array(j + at["bj"] * size), pa.array(total[0][i, j])], [*keys, "i", "j", "v"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "i long, j long, v double"])
    return left.join(right, [*keys, "bk"]).groupBy(*names).applyInArrow(multiply, schema)


def csr(matrix: DataFrame, keys: list[str] | None = None, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Compressed rows: entries ([keys], pos, i, j, v) in order of row and column, repeated ones
    kept, and pointers ([keys], i, start, stop) of the rows that have entries.

    Positions are prefix sums on two levels, over blocks of ``block`` rows and over the (row,
    stretch of columns) cells within each, plus a rank in the cell: no window holds a matrix, and
    a row with a third of all entries is dealt by its columns.
    """
    keys = keys or []
    rows = matrix.withColumns({"_b": F.floor(F.col("i") / block), "_c": F.floor(F.col("j") / block)})
    cells = rows.groupBy(*keys, "_b", "i", "_c").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).withColumn("_s", before(Window.partitionBy(*keys).orderBy("_b"))).drop("_n")
    starts = cells.join(blocks, [*keys, "_b"]).withColumn("_s", F.col("_s") + before(Window.partitionBy(*keys, "_b").orderBy("i", "_c")))
    rank = F.row_number().over(Window.partitionBy(*keys, "i", "_c").orderBy("j", "v")) - 1
    entries = rows.withColumn("_r", rank).join(starts.select(*keys, "i", "_c", "_s"), [*keys, "i", "_c"])
    pointers = starts.groupBy(*keys, "i").agg(F.min("_s").alias("start"), F.max(F.col("_s") + F.col("_n")).alias("stop"))
    return entries.select(*keys, (F.col("_s") + F.col("_r")).alias("pos"), "i", "j", "v"), pointers


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.withColumns({"i": F.col("j"), "j": F.col("i")})


def coalesce_entries(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Repeated entries summed."""
    return matrix.groupBy(*(keys or []), "i", "j").agg(F.sum("v").alias("v"))


def put(matrix: DataFrame, i: int, j: int, v: float) -> DataFrame:
    """The matrix with one entry set."""
    rest = matrix.where(~((F.col("i") == i) & (F.col("j") == j)))
    return rest.unionByName(matrix.sparkSession.createDataFrame([(i, j, v)], "i long, j long, v double"), allowMissingColumns=True)


def asymmetry(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """([keys], worst): the largest |A(i,j) - A(j,i)|, absent entries counting as 0."""
    keys = keys or []
    other = transpose(matrix).select(*keys, "i", "j", F.col("v").alias("w"))
    both = matrix.join(other, [*keys, "i", "j"], "full_outer")
    return both.groupBy(*keys).agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))).alias("worst"))


def well_posed(matrix: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """([keys], posed): every row 0..n-1 has entries and none lies outside."""
    keys = keys or []
    return matrix.groupBy(*keys).agg(((F.countDistinct("i") == n) & (F.min("i") >= 0) & (F.max("i") < n) & (F.min("j") >= 0) & (F.max("j") < n)).alias("posed"))


def dirichlet(matrix: DataFrame, rhs: DataFrame, i: int, value: float) -> tuple[DataFrame, DataFrame]:
    """The system with row i replaced by the identity and its right side by the value."""
    rows = matrix.where(F.col("i") != i).unionByName(matrix.sparkSession.createDataFrame([(i, i, 1.0)], "i long, j long, v double"), allowMissingColumns=True)
    return rows, rhs.withColumn("x", F.when(F.col("i") == i, F.lit(value)).otherwise(F.col("x")))


def residual(matrix: DataFrame, x: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """([keys], residual): |b - A x|."""
    keys = keys or []
    both = b.select(*keys, "i", F.col("x").alias("b")).join(spmv(matrix, x, keys), [*keys, "i"], "full_outer")
    d = F.coalesce("b", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return both.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("residual"))


def poisson_1d(spark, n: int) -> tuple[DataFrame, DataFrame]:
    """The n x n second-difference system with h = 1 / (n + 1) and right side 1."""
    h2 = 1.0 / (n + 1) ** 2
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.struct((F.col("id") - 1).alias("j"), F.lit(-1.0 / h2).alias("v")), F.struct(F.col("id").alias("j"), F.lit(2.0 / h2).alias("v")), F.struct((F.col("id") + 1).alias("j"), F.lit(-1.0 / h2).alias("v")))).alias("e"))
    return rows.select("i", "e.j", "e.v").where(F.col("j").between(0, n - 1)), spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))


def _keep(df: DataFrame) -> DataFrame:
    from .iterate import keep

    return keep(df)


#: A cell of a standing matrix takes at most about this many values of a vector.
VALUES_A_CELL = 4_000_000
#: Unless false, a join deals both sides anew by all of its keys.
PART_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Standing:
    """A matrix of about ``n`` rows for many products, with the solver's vectors beside it.

    The matrix is written once, as a table bucketed by cells of rows and columns: a product moves
    the vector to the cells of its columns and each cell's sums to their rows, never the matrix.
    A cell's task holds the values of its columns and the sums of its rows only.  ``keep`` writes
    vectors bucketed by row, so that they meet products where they lie.

    All is to be written within the context, where joins may follow buckets of part of their keys.
    """

    def __init__(self, matrix: DataFrame, n: int):
        self.spark = spark = matrix.sparkSession
        self.side = max(4, math.ceil(spark.sparkContext.defaultParallelism**0.5), math.ceil(n / VALUES_A_CELL))
        self.labels = F.array(*(F.lit(k) for k in _labels(spark, self.side**2)))
        self.names: list[str] = []
        self.before = spark.conf.get(PART_OF_KEYS)
        placed = matrix.select("i", "j", "v", self._cell(self._part("i"), self._part("j")))
        self.entries = self._table(placed.repartition(self.side**2, "_cell"), "_cell")

    def _part(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.side)).cast("int")

    def _cell(self, row: Column, column: Column) -> Column:
        return F.element_at(self.labels, row * self.side + column + 1).alias("_cell")

    def _table(self, df: DataFrame, key: str) -> DataFrame:
        self.names.append(f"standing_{uuid.uuid4().hex}")
        df.write.bucketBy(self.side**2, key).option("path", shared_folder(self.spark, "standing")).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def __enter__(self) -> Standing:
        self.spark.conf.set(PART_OF_KEYS, "false")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(PART_OF_KEYS, self.before)
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """df(i, ...) written and read back."""
        return self._table(df.repartition(self.side**2, "i"), "i")

    def times(self, x: DataFrame) -> DataFrame:
        """(i, y) with y = A x, for x(i, x)."""
        rows = F.explode(F.sequence(F.lit(0), F.lit(self.side - 1))).alias("_r")
        sent = x.select(F.col("i").alias("j"), "x", rows).select("j", "x", self._cell(F.col("_r"), self._part("j"))).repartition(self.side**2, "_cell")
        parts = self.entries.join(sent.hint("shuffle_hash"), ["_cell", "j"]).groupBy("_cell", "i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        return parts.select("i", "y").repartition(self.side**2, "i").groupBy("i").agg(F.sum("y").alias("y"))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which each of n partitions gets one."""
    tried = spark.range(50 * n).select(F.col("id").cast("int").alias("k"))
    found = tried.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("at")).agg(F.min("k").alias("k")).orderBy("at").collect()  # n rows
    return [r.k for r in found] if len(found) == n else list(range(n))


def jacobi(matrix: DataFrame, b: DataFrame, iterations: int, tolerance: float = 1e-10) -> DataFrame:
    """(i, x) after Jacobi sweeps from 0, until the residual falls below the tolerance.

    The product that tells a sweep's residual is the one that the next sweep starts from.
    """
    if iterations < 1:
        return b.select("i", F.lit(0.0).alias("x"))
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"), F.lit(True).alias("_d"))
    both = b.select("i", F.col("x").alias("b"), F.lit(True).alias("_b")).join(diagonal, "i", "full_outer")
    start = _keep(both.select("i", "b", "d", F.coalesce(F.col("_b") & F.col("_d"), F.lit(False)).alias("own"), (F.col("b") / F.col("d")).alias("x")))
    with Standing(matrix.where("i <> j"), start.count()) as off:
        state = off.keep(start)
        for _ in range(iterations - 1):
            y = off.times(state.where("own").select("i", "x"))
            state = off.keep(state.join(y, "i", "full_outer").withColumns({"own": F.coalesce("own", F.lit(False)), "y": F.coalesce("y", F.lit(0.0))}))
            left = F.coalesce("b", F.lit(0.0)) - F.col("y") - F.coalesce(F.when(F.col("own"), F.col("d") * F.col("x")), F.lit(0.0))
            if state.agg(F.sqrt(F.sum(left * left))).first()[0] < tolerance:
                break
            state = state.select("i", "b", "d", "own", ((F.col("b") - F.col("y")) / F.col("d")).alias("x"))
        return _keep(state.where("own").select("i", "x"))


def conjugate_gradient(matrix: DataFrame, b: DataFrame, iterations: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(i, x) of a symmetric positive system from 0; stops at tolerance times the first
    residual, or at the tolerance."""
    start = _keep(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("p")))
    n, rr = start.agg(F.count("*"), F.sum(F.col("r") * F.col("r"))).first()
    rr = rr or 0.0
    stop = max(tolerance * rr**0.5, tolerance)
    with Standing(matrix, n) as a:
        state = a.keep(start)
        for _ in range(iterations):
            if rr**0.5 <= stop:
                break
            ap = a.times(state.select("i", F.col("p").alias("x")))
            both = a.keep(state.join(ap, "i", "left").fillna(0.0, ["y"]))
            pap = both.agg(F.sum(F.col("p") * F.col("y"))).first()[0]
            if not pap:
                break
            alpha = rr / pap
            both = both.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("y")})
            new = both.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
            state = both.select("i", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p"))
            rr = new
        return _keep(state.select("i", "x"))


def bicgstab(matrix: DataFrame, b: DataFrame, iterations: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(i, x) of a general system from 0."""
    start = _keep(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r"), F.col("x").alias("r0"), F.col("x").alias("p")))
    n, rho = start.agg(F.count("*"), F.sum(F.col("r") * F.col("r0"))).first()
    rho = rho or 0.0
    first = rho**0.5
    with Standing(matrix, n) as a:
        s = a.keep(start)
        for _ in range(iterations):
            v = a.times(s.select("i", F.col("p").alias("x"))).withColumnRenamed("y", "v")
            s = a.keep(s.join(v, "i", "left").fillna(0.0, ["v"]))
            d = s.agg(F.sum(F.col("r0") * F.col("v"))).first()[0]
            if not d or not rho:
                break
            alpha = rho / d
            s = s.select("i", "x", "r0", "p", "v", (F.col("r") - alpha * F.col("v")).alias("s"))
            t = a.times(s.select("i", F.col("s").alias("x"))).withColumnRenamed("y", "t")
            s = a.keep(s.join(t, "i", "left").fillna(0.0, ["t"]))
            tt, ts = s.agg(F.sum(F.col("t") * F.col("t")), F.sum(F.col("t") * F.col("s"))).first()
            omega = ts / tt if tt else 0.0
            s = s.withColumns({"x": F.col("x") + alpha * F.col("p") + omega * F.col("s"), "r": F.col("s") - omega * F.col("t")})
            new, norm = s.agg(F.sum(F.col("r") * F.col("r0")), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
            if norm <= max(tolerance * first, tolerance) or not omega:
                break
            beta = (new / rho) * (alpha / omega)
            s = s.select("i", "x", "r", "r0", (F.col("r") + beta * (F.col("p") - omega * F.col("v"))).alias("p"))
            rho = new
        return _keep(s.select("i", "x"))
