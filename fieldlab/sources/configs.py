"""Configuration files: INI, JSON, YAML and environment variables as flat keys.

Configurations are small: they are read on the driver into a dictionary of dotted keys and
become rows with ``operators.config.to_rows``.  ``ini_table`` reads any number of INI files in
Spark instead.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def infer(text: str) -> object:
    """bool, int, float, array, else the text itself."""
    t = text.strip()
    if t.lower() in ("true", "false", "yes", "no"):
        return t.lower() in ("true", "yes")
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return float(t)
    if t.startswith("[") and t.endswith("]"):
        inner = t[1:-1].strip()
        return [infer(x) for x in inner.split(",")] if inner else []
    return t.strip("\"'")


def flatten(tree: Mapping, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, Mapping):
            out |= flatten(v, key)
        else:
            out[key] = v
    return out


def unflatten(values: Mapping[str, object]) -> dict:
    tree: dict = {}
    for key, v in values.items():
        *path, last = key.split(".")
        at = tree
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return tree


def read_ini(text: str) -> tuple[dict[str, str], list[str]]:
    """(values, problems): ``[section]`` prefixes keys, ``#`` starts a comment, other lines
    without ``=`` are skipped and reported."""
    values, problems, section = {}, [], ""
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif "=" in line:
            k, v = line.split("=", 1)
            values[f"{section}.{k.strip()}" if section else k.strip()] = v.strip()
        else:
            problems.append(f"line {n}: {raw.strip()}")
    return values, problems


def ini_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of all INI files under a path."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw"))
    rows = text.withColumn("line", F.trim(F.regexp_replace("raw", "#.*", ""))).where("line <> ''")
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), F.trim(F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    rows = rows.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))).where(F.col("line").contains("=") & ~F.col("line").rlike(r"^\[.*\]$"))
    key = F.trim(F.substring_index("line", "=", 1))
    value = F.trim(F.regexp_extract("line", "=(.*)$", 1))
    return rows.select("file", F.when(F.coalesce("section", F.lit("")) != "", F.concat_ws(".", "section", key)).otherwise(key).alias("key"), value.alias("value"))


def from_environment(prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, object]:
    env = os.environ if environment is None else environment
    return {k[len(prefix) :].lower().replace("_", "."): infer(v) for k, v in sorted(env.items()) if k.startswith(prefix) and len(k) > len(prefix)}


def parse(text: str, kind: str) -> dict[str, object]:
    """Flat keys of a json, yaml, yml, ini or cfg text."""
    if kind == "json":
        return flatten(json.loads(text))
    if kind in ("yaml", "yml"):
        import yaml

        return flatten(yaml.safe_load(text) or {})
    if kind in ("ini", "cfg"):
        return {k: infer(v) for k, v in read_ini(text)[0].items()}
    raise ValueError(f"unknown format {kind}")


def load(path: str) -> dict[str, object]:
    """Flat keys of a local configuration file, by its extension."""
    with open(path) as f:
        return parse(f.read(), path.rsplit(".", 1)[-1].lower())


def read(spark: SparkSession, path: str) -> dict[str, object]:
    """Flat keys of one configuration file wherever Spark reads from, by its extension."""
    return parse(spark.read.text(path, wholetext=True).first().value, path.rsplit(".", 1)[-1].lower())


def save(values: Mapping[str, object], path: str) -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        text = json.dumps(unflatten(values), indent=2, sort_keys=True)
    elif kind in ("yaml", "yml"):
        import yaml

        text = yaml.safe_dump(unflatten(values), sort_keys=True)
    else:
        raise ValueError(f"unknown format {kind}")
    with open(path, "w") as f:
        f.write(text + "\n")
