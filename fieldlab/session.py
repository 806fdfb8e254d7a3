"""Session defaults and small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def make_session(app: str = "fieldlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def col(x: Column | str | float | int) -> Column:
    """A column by name, a literal by number, a Column as it is."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all cores, where rows cost much more than their bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def parts(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions for about ``each`` rows a task, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which driver and executors share; a
    temporary folder takes its place only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fieldlab-checkpoint-")
        sc.setCheckpointDir(path)
    return f"{path}/fieldlab/{name}-{uuid.uuid4().hex}"
