"""Checks of inputs and of fitted estimators, and timers."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.base import Features

log = logging.getLogger("quillon")


def check_array(df: DataFrame, features: Features, *, allow_missing: bool = False, min_rows: int = 1, min_features: int = 1) -> int:
    """The number of features of a frame that can be learned from; one pass over it.

    Features must be numeric, rows of one width and, unless ``allow_missing``,
    without null, NaN or infinity.  Raises TypeError for other types and
    ValueError for the rest.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = isinstance(features, str)
    for name in [features] if one else features:
        kind = kinds.get(name)
        if kind is None:
            raise ValueError(f"there is no column {name!r}")
        kind = kind.elementType if one and isinstance(kind, T.ArrayType) else None if one else kind
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"column {name!r} isn't {'an array of numbers' if one else 'numeric'}")
    values = F.col(f"`{features}`").cast("array<double>") if one else F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    odd = values.isNull() | F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sizes = F.size(values)
    rows, low, high, bad = df.agg(F.count(F.lit(1)), F.min(F.when(values.isNotNull(), sizes)), F.max(F.when(values.isNotNull(), sizes)), F.sum(odd.cast("long"))).first()
    if rows < min_rows:
        raise ValueError(f"{rows} rows, at least {min_rows} are needed")
    if low != high:
        raise ValueError(f"rows have between {low} and {high} features")
    if (high or 0) < min_features:
        raise ValueError(f"{high} features, at least {min_features} are needed")
    if bad and not allow_missing:
        raise ValueError(f"{bad} rows have missing or infinite values")
    return int(high or 0)


def check_x_y(df: DataFrame, features: Features, label: str, **checks: object) -> int:
    """``check_array``, and a label that is there in every row."""
    size = check_array(df, features, **checks)
    if label not in df.columns:
        raise ValueError(f"there is no column {label!r}")
    y = F.col(f"`{label}`")
    missing = y.isNull() | F.isnan(y) if isinstance(df.schema[label].dataType, (T.DoubleType, T.FloatType)) else y.isNull()
    if not df.where(missing).isEmpty():
        raise ValueError(f"rows without a label {label!r}")
    return size


def check_n_features(estimator: object, df: DataFrame, features: Features) -> None:
    """Raises ValueError unless ``df`` has as many features as ``estimator`` was fitted with."""
    size = check_array(df, features, allow_missing=True, min_rows=0, min_features=0)
    if size != estimator.n_features_in_:
        raise ValueError(f"{size} features, {type(estimator).__name__} was fitted with {estimator.n_features_in_}")


def check_blocks(n_rows: int, n_features: int, blocks: int | Sequence[int] | None = None, workers: int = 8, least: int = 100) -> tuple[int, int]:
    """(rows, features) of a block: whole rows, and at least ``least`` of them where nothing is asked for.

    A number asks for so many rows; a pair gives both, and must span all features.
    """
    if blocks is None:
        return max(least, n_rows // workers), n_features
    if isinstance(blocks, (int, np.integer)):
        return int(blocks), n_features
    if len(blocks) != 2:
        raise ValueError("blocks are given as a number of rows or as (rows, features)")
    if blocks[1] != n_features:
        raise ValueError("blocks must hold all features of their rows")
    return int(blocks[0]), int(blocks[1])


def assert_estimator_equal(left: object, right: object, exclude: Sequence[str] = (), rtol: float = 1e-7, atol: float = 1e-9) -> None:
    """AssertionError unless both have the same learned attributes with equal values."""
    learned = [{k for k in vars(x) if k.endswith("_") and not k.startswith("_")} - set(exclude) for x in (left, right)]
    assert learned[0] == learned[1], f"learned attributes differ: {sorted(learned[0] ^ learned[1])}"
    for name in sorted(learned[0]):
        _assert_same(getattr(left, name), getattr(right, name), name, rtol, atol)


def _assert_same(a: object, b: object, name: str, rtol: float, atol: float) -> None:
    if isinstance(a, dict):
        assert isinstance(b, dict) and a.keys() == b.keys(), f"{name}: keys differ"
        for k in a:
            _assert_same(a[k], b[k], f"{name}[{k!r}]", rtol, atol)
    elif isinstance(a, (list, tuple)) and any(isinstance(x, (list, tuple, dict, np.ndarray)) or hasattr(x, "get_params") for x in a):
        assert len(a) == len(b), f"{name}: lengths differ"
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            _assert_same(x, y, f"{name}[{k}]", rtol, atol)
    elif hasattr(a, "get_params"):
        assert type(a) is type(b), f"{name}: types differ"
        assert_estimator_equal(a, b, rtol=rtol, atol=atol)
    elif isinstance(a, DataFrame):
        assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), f"{name}: frames differ"
    elif np.asarray(a).dtype.kind in "fiub":
        np.testing.assert_allclose(a, b, rtol=rtol, atol=atol, err_msg=name)
    else:
        assert np.array_equal(np.asarray(a, dtype=object), np.asarray(b, dtype=object)), f"{name}: {a!r} and {b!r}"


def num_rows(data: DataFrame | np.ndarray | Sequence) -> int:
    """Rows of a frame, an array or a sequence."""
    return data.count() if isinstance(data, DataFrame) else len(data)


@contextmanager
def timer(name: str, level: int = logging.INFO, sink: list | None = None) -> Iterator[None]:
    """Logs the seconds that the block took; appends (name, seconds) to ``sink``."""
    start = time.perf_counter()
    log.log(level, "%s started", name)
    try:
        yield
    finally:
        took = time.perf_counter() - start
        log.log(level, "%s took %.3f s", name, took)
        if sink is not None:
            sink.append((name, took))
