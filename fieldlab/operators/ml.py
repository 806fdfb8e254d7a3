"""Inference and inverse problems: networks from exported weights, fitted diffusivities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVATIONS = {"tanh": np.tanh, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "identity": lambda x: x}


def predict(rows: DataFrame, inputs: Sequence[str], weights: Sequence[tuple[np.ndarray, np.ndarray]], activation: str = "tanh", output: str = "prediction") -> DataFrame:
    """rows with the first output of a dense network, a batch at a time.

    ``weights`` are (matrix (in, out), bias (out)) a layer; they travel with the plan, so
    they are bounded by what a task description may hold.
    """
    act = ACTIVATIONS[activation]
    layers = [(np.asarray(w, float), np.asarray(b, float)) for w, b in weights]
    if sum(w.size + b.size for w, b in layers) > 4_000_000:
        raise ValueError("more than 4 million weights")
    names = list(inputs)
    schema = rows.withColumn(output, F.lit(0.0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[names].to_numpy(float)
            for k, (w, b) in enumerate(layers):
                x = x @ w + b
                if k + 1 < len(layers):
                    x = act(x)
            yield part.assign(**{output: x[:, 0] if len(part) else np.zeros(0)})

    return rows.mapInPandas(run, schema)


def fit_diffusivity(rows: DataFrame, key: str, u_t: str, u_xx: str) -> DataFrame:
    """(key, D, r2): the least-squares slope of u_t over u_xx."""
    return rows.groupBy(key).agg(F.regr_slope(u_t, u_xx).alias("D"), F.regr_r2(u_t, u_xx).alias("r2"))


def residual_sample(rows: DataFrame, key: str, residual: str, n: int, seed: int = 0) -> DataFrame:
    """n rows a key drawn without replacement with odds that follow |residual|: the largest
    exponential keys, drawn by hash, so reruns agree.  A sampling operator."""
    from pyspark.sql import Window

    u = (F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 2)
    draw = F.log(u) / F.greatest(F.abs(F.col(residual)), F.lit(1e-12))
    w = Window.partitionBy(key).orderBy(F.col("_d").desc())
    return rows.withColumn("_d", draw).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_d", "_r")
