"""Distances and kernels of every row to the rows of a small matrix.

The matrix is a NumPy array on the driver (a TypeError otherwise), so that its
size is known; it becomes literals of a projection, and nothing is joined.
Results are array columns in the order of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.base import Features, dot, literal, matrix, squared_distance, vector, width

#: Cells up to which a matrix becomes literals; a larger one goes to Arrow batches.
LITERAL_CELLS = 4096


def check_pairwise(df: DataFrame, features: Features, y: np.ndarray) -> np.ndarray:
    if not isinstance(y, np.ndarray):
        raise TypeError("Y must be a NumPy array")
    y = np.atleast_2d(y.astype(float))
    if width(df, features) != y.shape[1]:
        raise ValueError(f"Incompatible dimension for X and Y matrices: {width(df, features)} and {y.shape[1]}")
    return y


def row_norms(features: Features, squared: bool = False) -> Column:
    total = dot(vector(features), vector(features))
    return total if squared else F.sqrt(total)


def _each(df: DataFrame, features: Features, y: np.ndarray, native: Callable[[Column, Column], Column], batch: Callable[[np.ndarray, np.ndarray], np.ndarray], output: str) -> DataFrame:
    y = check_pairwise(df, features, y)
    if y.size <= LITERAL_CELLS:
        return df.withColumn(output, F.array(*[native(vector(features), literal(row)) for row in y]))
    rows = df.withColumn(output, vector(features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                part[output] = list(batch(matrix(part[output]), y))
            yield part

    return rows.mapInPandas(run, rows.schema)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of squared differences, as in the expression for few rows of ``y``: norms less twice the product would lose digits."""
    out = np.empty((len(x), len(y)))
    for k, row in enumerate(y):
        out[:, k] = ((x - row) ** 2).sum(1)
    return out


def euclidean_distances(df: DataFrame, features: Features, y: np.ndarray, squared: bool = False, output: str = "distances") -> DataFrame:
    finish = (lambda c: c) if squared else F.sqrt
    root = (lambda a: a) if squared else np.sqrt
    return _each(df, features, y, lambda a, b: finish(squared_distance(a, b)), lambda a, b: root(_squared(a, b)), output)


def linear_kernel(df: DataFrame, features: Features, y: np.ndarray, output: str = "kernel") -> DataFrame:
    return _each(df, features, y, dot, lambda a, b: a @ b.T, output)


def rbf_kernel(df: DataFrame, features: Features, y: np.ndarray, gamma: float | None = None, output: str = "kernel") -> DataFrame:
    g = gamma if gamma is not None else 1 / np.atleast_2d(y).shape[1]
    return _each(df, features, y, lambda a, b: F.exp(-g * squared_distance(a, b)), lambda a, b: np.exp(-g * _squared(a, b)), output)


def polynomial_kernel(df: DataFrame, features: Features, y: np.ndarray, degree: int = 3, gamma: float | None = None, coef0: float = 1, output: str = "kernel") -> DataFrame:
    g = gamma if gamma is not None else 1 / np.atleast_2d(y).shape[1]
    return _each(df, features, y, lambda a, b: F.pow(g * dot(a, b) + coef0, F.lit(degree)), lambda a, b: (g * a @ b.T + coef0) ** degree, output)


def sigmoid_kernel(df: DataFrame, features: Features, y: np.ndarray, gamma: float | None = None, coef0: float = 1, output: str = "kernel") -> DataFrame:
    g = gamma if gamma is not None else 1 / np.atleast_2d(y).shape[1]
    return _each(df, features, y, lambda a, b: F.tanh(g * dot(a, b) + coef0), lambda a, b: np.tanh(g * a @ b.T + coef0), output)


def _callable(metric: Callable) -> Callable:
    def made(df: DataFrame, features: Features, y: np.ndarray, output: str = "distances", **kw: object) -> DataFrame:
        y = check_pairwise(df, features, y)
        rows = df.withColumn(output, vector(features))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    part[output] = list(np.asarray(metric(matrix(part[output]), y, **kw), dtype=float))
                yield part

        return rows.mapInPandas(run, rows.schema)

    return made


METRICS = {"euclidean": euclidean_distances}
KERNELS = {"linear": linear_kernel, "rbf": rbf_kernel, "polynomial": polynomial_kernel, "poly": polynomial_kernel, "sigmoid": sigmoid_kernel}


def pairwise_distances(df: DataFrame, features: Features, y: np.ndarray, metric: str | Callable = "euclidean", output: str = "distances", **kw: object) -> DataFrame:
    """``metric`` is a name, or a function of two matrices."""
    if callable(metric):
        return _callable(metric)(df, features, y, output=output, **kw)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return METRICS[metric](df, features, y, output=output, **kw)


def pairwise_kernels(df: DataFrame, features: Features, y: np.ndarray | None = None, metric: str | Callable = "linear", filter_params: bool = False, output: str = "kernel", **kw: object) -> DataFrame:
    if metric == "precomputed":
        return df.withColumn(output, vector(features))
    if callable(metric):
        raise NotImplementedError("callable kernels")
    if metric not in KERNELS:
        raise ValueError(f"Unknown kernel {metric!r}")
    if filter_params:
        allowed = {"rbf": {"gamma"}, "sigmoid": {"gamma", "coef0"}, "linear": set()}.get(metric, {"gamma", "coef0", "degree"})
        kw = {k: v for k, v in kw.items() if k in allowed}
    return KERNELS[metric](df, features, y, output=output, **kw)


def pairwise_distances_argmin_min(df: DataFrame, features: Features, y: np.ndarray, metric: str | Callable = "euclidean", index: str = "nearest", distance: str = "distance") -> DataFrame:
    """Position (first of equals) and distance of the nearest row of ``y``."""
    found = pairwise_distances(df, features, y, metric, output="__distances")
    least = F.array_min("__distances")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.array_position("__distances", least) - 1).cast("int").alias(index), least.alias(distance))
