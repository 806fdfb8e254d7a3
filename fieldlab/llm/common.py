"""Session plumbing for the corpus operators: inputs, shared storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts, as a Java pattern over the characters of a text.
SPACE = " \\t\\n\\x0B\\f\\r"


def free_name(columns: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that clashes with none of the columns."""
    taken = {c.lower() for c in columns}
    return next(n for n in (wanted, *(f"{wanted}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on
    one machine (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fieldlab-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldlab/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan starts anew there, and a
    lost executor costs no more than the rereading of files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df; nothing may read it any more."""
    if path := getattr(df, "_scratch", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(df: DataFrame, column: str) -> int:
    """All bytes of a text column: one scan, one number."""
    return int(df.select(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])
