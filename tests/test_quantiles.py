"""Exact percentiles: ranks over ranges against one aggregation and NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import quantiles
from quillon.functions.quantiles import exact_percentiles
from quillon.operators.scalers import QuantileTransformer, RobustScaler, SimpleImputer

AT = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3000):
        hot = 7.5 if k % 3 else float(rng.normal())  # two thirds of the rows are one value
        rows.append((float(rng.lognormal()), hot, None, float(k % 2), None if k % 5 else -float(k)))
    return spark.createDataFrame(rows, "a double, hot double, none double, two double, gaps double").repartition(5)


def test_ranks_equal_numpy_and_the_aggregation(odd, monkeypatch):
    columns = [F.col(c) for c in odd.columns]
    held = exact_percentiles(odd, columns, AT)
    monkeypatch.setattr(quantiles, "HELD_VALUES", 0)
    ranked = exact_percentiles(odd, columns, AT)
    assert ranked == held and held[2] is None
    rows = odd.toPandas()
    for name, got in zip(odd.columns, ranked, strict=True):
        if got is not None:
            assert np.allclose(got, np.quantile(rows[name].dropna().astype(float), AT), rtol=1e-12, atol=1e-12)


def test_ranks_of_empty_and_single_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD_VALUES", -1)
    empty = spark.createDataFrame([], "a double, b double")
    assert exact_percentiles(empty, [F.col("a"), F.col("b")], AT) == [None, None]
    single = spark.createDataFrame([(4.0,)], "a double")
    assert exact_percentiles(single, [F.col("a")], AT) == [[4.0] * len(AT)]
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "a double")
    assert exact_percentiles(ends, [F.col("a")], [0, 0.5, 1]) == [[float("-inf"), 1.0, float("inf")]]


def test_ranks_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD_VALUES", 0)
    numbers = spark.range(20001).select(F.col("id").cast("double").alias("v"))
    assert exact_percentiles(numbers, [F.col("v")], [0.5, 0.25]) == [[10000.0, 5000.0]]


def test_operators_fit_alike_both_ways(odd, monkeypatch):
    def fitted():
        names = ["a", "hot", "two", "gaps"]
        return (
            RobustScaler(columns=names).fit(odd).center_.tolist(),
            QuantileTransformer(n_quantiles=50, columns=names).fit(odd).quantiles_.tolist(),
            SimpleImputer("median", columns=[*names, "none"]).fit(odd).statistics_,
        )

    held = fitted()
    monkeypatch.setattr(quantiles, "HELD_VALUES", 0)
    assert fitted() == held
