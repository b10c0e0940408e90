"""Estimators: parameters in the constructor, fitted attributes with a trailing underscore."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotFittedError(ValueError):
    """The estimator has no fitted attributes yet."""


class Estimator:
    """Parameter handling; subclasses keep each constructor argument as an attribute of its name."""

    @classmethod
    def _names(cls) -> list[str]:
        return [p.name for p in inspect.signature(cls.__init__).parameters.values() if p.name != "self" and p.kind != p.VAR_KEYWORD]

    def get_params(self, deep: bool = True) -> dict:
        out = {n: getattr(self, n) for n in self._names()}
        if deep:
            for name, value in list(out.items()):
                if hasattr(value, "get_params") and not isinstance(value, type):
                    out |= {f"{name}__{k}": v for k, v in value.get_params().items()}
        return out

    def set_params(self, **params: object) -> Estimator:
        for name, value in params.items():
            own, _, rest = name.partition("__")
            if own not in self._names():
                raise ValueError(f"{type(self).__name__} has no parameter {own!r}")
            if rest:
                getattr(self, own).set_params(**{rest: value})
            else:
                setattr(self, own, value)
        return self

    def check_fitted(self, name: str) -> None:
        if not hasattr(self, name):
            raise NotFittedError(f"{type(self).__name__} is not fitted")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params(deep=False).items())})"


def clone(estimator: object) -> object:
    """A new estimator with the same parameters; nested estimators are cloned too, also within lists of steps."""

    def copied(v: object) -> object:
        if isinstance(v, (list, tuple)) and any(isinstance(x, (list, tuple)) or hasattr(x, "get_params") for x in v):
            return type(v)(map(copied, v))
        return clone(v) if hasattr(v, "get_params") and not isinstance(v, type) else v

    return type(estimator)(**{k: copied(v) for k, v in estimator.get_params(deep=False).items()})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value(name: str | Column) -> Column:
    """A double in which NaN counts as missing."""
    column = (F.col(f"`{name}`") if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(column), column)


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with columns replaced or added in one projection."""
    kept = [new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(*kept, *[c.alias(n) for n, c in new.items() if n not in df.columns])


Features = str | Sequence[str]


def vector(features: Features) -> Column:
    """One array<double> column: an array column by its name, or several numeric columns."""
    if isinstance(features, str):
        return F.col(f"`{features}`").cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def width(df: DataFrame, features: Features) -> int:
    if not isinstance(features, str):
        return len(features)
    row = df.select(F.size(features)).first()
    if row is None:
        raise ValueError("Found array with 0 sample(s)")
    return int(row[0])


def literal(values: np.ndarray) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in np.asarray(values).ravel()])


def matrix(values: pd.Series) -> np.ndarray:
    """Rows of a column of arrays, which must be of one length."""
    if not len(values):
        return np.zeros((0, 0))
    if not isinstance(values.iloc[0], np.ndarray):
        return np.array(values.tolist(), dtype=float)
    size = len(values.iloc[0])
    if any(len(v) != size for v in values):
        raise ValueError("arrays of several lengths")
    return np.concatenate(values.to_numpy()).reshape(len(values), size).astype(float, copy=False)


def arrow_values(column: pa.Array) -> np.ndarray:
    """A numeric Arrow column as it lies in memory; a column of arrays as a matrix."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = len(flat) // max(1, len(column))
    if pc.any(pc.not_equal(pc.list_value_length(column), size)).as_py() or column.null_count:
        raise ValueError("arrays of several lengths")
    return flat.reshape(len(column), size).astype(float, copy=False)


#: Numbers of features that a learner gets in one call at most, and the step of the rows of such a call.
CALL_CELLS, CALL_STEP = 1 << 22, 64


def pieces(batches: Iterator[pa.RecordBatch], names: Sequence[str], cells: int = CALL_CELLS) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(values of ``names``, matrix of ``x``, ``y``) of each run of rows with equal ``names``.

    A long run comes in several pieces of about ``cells`` features.  All but
    its last have a multiple of ``CALL_STEP`` rows, so that a learner that goes
    through mini-batches of that size takes the steps it takes on the whole run.
    """
    key, xs, ys, held = (), [], [], 0

    def made() -> tuple[tuple, np.ndarray, np.ndarray]:
        out = key, np.concatenate(xs), np.concatenate(ys)
        xs.clear()
        ys.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = arrow_values(batch.column("x")), batch.column("y").to_pandas().to_numpy()
        ids = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        edges = (np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1).tolist()
        most = max(1, cells // max(1, x.shape[1]) // CALL_STEP) * CALL_STEP
        for at, stop in zip([0, *edges], [*edges, len(y)], strict=True):
            new = tuple(v[at].item() for v in ids)
            if xs and new != key:
                yield made()
                held = 0
            key = new
            while at < stop:
                take = min(stop - at, most - held)
                xs.append(x[at : at + take])
                ys.append(y[at : at + take])
                at, held = at + take, held + take
                if held == most:
                    yield made()
                    held = 0
    if xs:
        yield made()


def partial_sums(df: DataFrame, columns: Sequence[Column], compute: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` sums that ``compute`` makes of a batch.

    Each task adds up its batches and hands over one vector; the vectors are
    added position by position behind a shuffle of ``size`` rows a task.
    """
    names = [f"c{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += compute(*map(arrow_values, batch.columns))
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"k": np.arange(size), "v": total})

    rows = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]).mapInArrow(run, "k long, v double")
    out = np.zeros(size)
    for row in rows.groupBy("k").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[row["k"]] = row["v"]
    return out


#: Bytes of a packed matrix and of the matrices of a task, and numbers of sums that tasks hand to the driver without a shuffle.
PACK_BYTES, TASK_BYTES, DIRECT_SUMS = 1 << 20, 1 << 24, 1024


def packed(df: DataFrame, ones: bool = False) -> DataFrame:
    """The columns ``x`` (arrays) and ``y`` of ``df`` as matrices in binary form, for many passes over the same rows.

    A pass hands over a few values of about ``PACK_BYTES`` in place of each number
    of each row.  ``ones`` adds a last column of ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (arrow_values(c).astype(float, copy=False) for c in batch.columns)
                step = max(1, PACK_BYTES // (8 * (x.shape[1] + ones)))
                for at in range(0, len(y), step):
                    part = x[at : at + step]
                    part = np.column_stack((part, np.ones(len(part)))) if ones else part
                    yield pa.RecordBatch.from_pydict({"x": [part.tobytes()], "y": [y[at : at + step].tobytes()]})

    return df.select("x", "y").mapInArrow(run, "x binary, y binary")


def kept_packed(df: DataFrame, ones: bool = False) -> DataFrame:
    """What ``packed`` makes, persisted; in fewer partitions where they are small, as each costs a task in every pass."""
    rows = packed(df, ones).persist()
    tasks = -(-(rows.agg(F.sum(F.octet_length("x"))).first()[0] or 1) // TASK_BYTES)
    if 2 * tasks > rows.rdd.getNumPartitions():
        return rows
    few = rows.coalesce(tasks).persist()
    few.count()
    rows.unpersist()
    return few


def packed_sums(rows: DataFrame, compute: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``partial_sums`` over what ``packed`` has made."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for x, y in zip(*batch.columns, strict=True):
                y = np.frombuffer(y.as_buffer())
                made = compute(np.frombuffer(x.as_buffer()).reshape(len(y), -1), y)
                total = made if total is None else total + made
        return total

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (total := sums(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (total := sums(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"k": np.arange(size), "v": total})

    out = np.zeros(size)
    if size <= DIRECT_SUMS:
        for row in rows.mapInArrow(whole, "v binary").collect():  # one vector for each task
            out += np.frombuffer(row["v"])
        return out
    for row in rows.mapInArrow(long, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[row["k"]] = row["v"]
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Numbers of components up to which products are expressions in the plan.
PROJECT_CELLS = 1024


def projected(df: DataFrame, features: Features, components: np.ndarray, shift: np.ndarray | None, output: str) -> DataFrame:
    """``df`` with the products of ``project``: as an expression while they are few, else as matrices of Arrow batches."""
    components = np.atleast_2d(components)
    if components.size <= PROJECT_CELLS:
        return df.withColumn(output, project(vector(features), components, shift))
    kept = [c for c in df.columns if c != output]
    centre = np.zeros(components.shape[1]) if shift is None else np.asarray(shift, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept))
            full = x.is_valid()
            made = ((arrow_values(x.filter(full)) if pc.any(full).as_py() else np.zeros((0, len(centre)))) - centre) @ components.T
            lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), len(components)).cast(pa.list_(pa.float64()))
            place = pc.if_else(full, pc.subtract(pc.cumulative_sum(full.cast(pa.int64())), 1), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists.take(place)], [*kept, output])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != output], f"`{output}` array<double>"])
    return df.select(*[f"`{c}`" for c in kept], vector(features).alias("__x")).mapInArrow(run, schema)


def project(features: Column, components: np.ndarray, shift: np.ndarray | None = None) -> Column:
    """Array of the dot products with the rows of ``components``, behind subtracting ``shift``."""
    centred = features if shift is None else F.zip_with(features, literal(shift), lambda x, m: x - m)
    return F.array(*[dot(centred, literal(row)) for row in np.atleast_2d(components)])
