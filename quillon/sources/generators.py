"""Synthetic frames: every value is a hash-free function of the row id and the seed, so that tasks can be repeated."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows whose values come from one random stream.
STREAM = 4096


def random_date(start: datetime, end: datetime, rng: np.random.Generator) -> datetime:
    """Uniform second in [start, end)."""
    return start + timedelta(seconds=int(rng.integers(max(1, int((end - start).total_seconds())))))


def _frame(spark: SparkSession, n: int, seed: int, schema: str, make: object) -> DataFrame:
    """Streams of STREAM rows, each from its own generator; ``make(rng, ids)`` gives the columns."""
    streams = -(-n // STREAM)
    parts = max(1, min(streams, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream in batch["id"]:
                ids = np.arange(stream * STREAM, min(n, (stream + 1) * STREAM))
                yield pd.DataFrame({"id": ids} | make(np.random.default_rng((seed, int(stream))), ids))

    return spark.range(0, streams, 1, parts).mapInPandas(run, f"id long, {schema}")


def make_counts(spark: SparkSession, n_samples: int = 1000, n_features: int = 100, n_informative: int = 2, scale: float = 1.0, random_state: int = 0) -> DataFrame:
    """(id, x, y): Poisson counts whose log rate is linear in a few features."""
    rng = np.random.default_rng(random_state)
    at, beta = rng.choice(n_features, n_informative, replace=False), (rng.random(n_informative) - 1) * scale

    def make(own: np.random.Generator, ids: np.ndarray) -> dict:
        x = own.normal(size=(len(ids), n_features))
        return {"x": list(x), "y": own.poisson(np.exp(x[:, at] @ beta))}

    return _frame(spark, n_samples, random_state + 1, "x array<double>, y long", make)


def make_blobs(spark: SparkSession, n_samples: int = 100, n_features: int = 2, centers: int | Sequence | None = None, cluster_std: float = 1.0, center_box: tuple[float, float] = (-10, 10), random_state: int = 0) -> DataFrame:
    """(id, x, y): normal clouds around centers, in turn."""
    rng = np.random.default_rng(random_state)
    if centers is None or isinstance(centers, int):
        centers = rng.uniform(*center_box, (centers or 3, n_features))
    centers = np.array(centers, dtype=float)

    def make(own: np.random.Generator, ids: np.ndarray) -> dict:
        y = ids % len(centers)
        return {"x": list(centers[y] + own.normal(scale=cluster_std, size=(len(ids), centers.shape[1]))), "y": y}

    return _frame(spark, n_samples, random_state + 1, "x array<double>, y long", make)


def make_regression(spark: SparkSession, n_samples: int = 100, n_features: int = 100, n_informative: int = 10, bias: float = 0.0, noise: float = 0.0, coef: bool = False, random_state: int = 0) -> DataFrame | tuple[DataFrame, np.ndarray]:
    """(id, x, y): linear targets; with ``coef`` the coefficients too."""
    rng = np.random.default_rng(random_state)
    truth = np.zeros(n_features)
    truth[rng.permutation(n_features)[: min(n_informative, n_features)]] = 100 * rng.random(min(n_informative, n_features))

    def make(own: np.random.Generator, ids: np.ndarray) -> dict:
        x = own.normal(size=(len(ids), n_features))
        return {"x": list(x), "y": x @ truth + bias + (own.normal(scale=noise, size=len(ids)) if noise else 0)}

    out = _frame(spark, n_samples, random_state + 1, "x array<double>, y double", make)
    return (out, truth) if coef else out


def make_classification(spark: SparkSession, n_samples: int = 100, n_features: int = 20, n_informative: int = 2, n_classes: int = 2, scale: float = 1.0, random_state: int = 0) -> DataFrame:
    """(id, x, y): two classes with logistic odds linear in a few features."""
    if n_classes != 2:
        raise NotImplementedError(f"only two classes can be made, not {n_classes}")
    rng = np.random.default_rng(random_state)
    at, beta = rng.choice(n_features, n_informative, replace=False), (rng.random(n_informative) - 1) * scale

    def make(own: np.random.Generator, ids: np.ndarray) -> dict:
        x = own.normal(size=(len(ids), n_features))
        return {"x": list(x), "y": (own.random(len(ids)) < 1 / (1 + np.exp(-x[:, at] @ beta))).astype(int)}

    return _frame(spark, n_samples, random_state + 1, "x array<double>, y int", make)


def make_classification_df(spark: SparkSession, n_samples: int = 10_000, response_rate: float = 0.5, predictability: float = 0.1, n_features: int = 20, random_state: int = 0, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """(id, var0.., target[, date]): one random date for all rows."""
    rng = np.random.default_rng(random_state)
    when = random_date(*dates, rng) if dates else None

    def make(own: np.random.Generator, ids: np.ndarray) -> dict:
        y = (own.random(len(ids)) < response_rate).astype(int)
        x = own.normal(size=(len(ids), n_features))
        x[:, 0] += 10 * predictability * (y - response_rate)
        out = {f"var{k}": x[:, k] for k in range(n_features)} | {"target": y}
        return out | ({"date": when} if when else {})

    schema = ", ".join([*[f"var{k} double" for k in range(n_features)], "target int", *(["date timestamp"] if when else [])])
    return _frame(spark, n_samples, random_state + 1, schema, make)
