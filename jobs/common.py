"""What the jobs share: settings, the command line, and counting what is read and written."""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators import config
from fieldlab.session import make_session
from fieldlab.sources import configs

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, schema: list[tuple], path: str | None, **given: object) -> dict[str, object]:
    """Defaults of the schema, the file's values over them, and ``given`` over both.

    Keys that are missing, of a wrong type, outside their rule or unknown are an error.
    """
    wanted = spark.createDataFrame(schema, config.SCHEMA)
    layers = [config.to_rows(spark, configs.read(spark, path))] if path else []
    if given:
        layers.append(config.to_rows(spark, given))
    named = config.layer(*layers) if layers else config.to_rows(spark, {})
    rows = config.defaults(named, wanted).select("key", "type", "value")
    bad = [f"{r.key}: {r.problem}" for r in config.validate(rows, wanted).collect()]
    bad += [f"{r.key}: unknown" for r in rows.join(wanted, "key", "left_anti").collect()]
    if bad:
        raise ValueError("settings: " + ", ".join(sorted(bad)))
    kinds = {k: t for k, t, *_ in schema}
    make = {"int": int, "double": float, "string": str, "bool": lambda v: v == "true"}
    return {r.key: make[kinds[r.key]](r.value) for r in rows.collect()}


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and its count of rows once it has been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def command(description: str, run: Callable[[SparkSession, argparse.Namespace], object], **paths: str) -> None:
    """Parse ``--name PATH`` for each path and an optional ``--config``, then run in a session
    of its own, which is stopped at the end."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a .json, .yaml or .ini file")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = make_session("job", os.environ.get("SPARK_MASTER"))
    try:
        run(spark, args)
    finally:
        spark.stop()
