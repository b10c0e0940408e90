"""Scalers, quantiles, polynomials, imputation: ``fit`` is one aggregation, ``transform`` one projection.

NaN and NULL are both missing: aggregations skip them, projections keep them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, combinations, combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.quantiles import distinct_sizes, exact_percentiles
from quillon.operators.base import Estimator, numeric_columns, replaced, value


def nonzero_scale(scale: np.ndarray) -> np.ndarray:
    """Scales by which one may divide: 0 becomes 1."""
    return np.where(scale == 0, 1.0, scale)


class _Columnwise(Estimator):
    columns: Sequence[str] | None

    def _resolve(self, df: DataFrame) -> list[str]:
        self.feature_names_in_ = list(self.columns) if self.columns is not None else numeric_columns(df)
        self.n_features_in_ = len(self.feature_names_in_)
        return self.feature_names_in_

    def _stats(self, df: DataFrame, makers: dict[str, Callable[[Column], Column]]) -> dict[str, np.ndarray]:
        """One aggregation for all statistics of all columns; also sets n_samples_seen_."""
        names = self._resolve(df)
        aggregates = [make(value(c)).alias(f"{s}{k}") for s, make in makers.items() for k, c in enumerate(names)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates).first()
        self.n_samples_seen_ = row["n"]
        return {s: np.array([np.nan if row[f"{s}{k}"] is None else row[f"{s}{k}"] for k in range(len(names))], dtype=object) for s in makers}

    def _percentiles(self, df: DataFrame, at: Sequence[float], accuracy: int | None) -> np.ndarray:
        """Columns by percentiles, NaN for columns without values."""
        if accuracy is None:
            sizes = self._stats(df, {"d": F.approx_count_distinct})["d"]
            stats = exact_percentiles(df, list(map(value, self.feature_names_in_)), at, int(sizes.sum()))
        else:
            points = F.array(*[F.lit(float(p)) for p in at])
            stats = self._stats(df, {"q": lambda c: F.percentile_approx(c, points, accuracy)})["q"]
        return np.array([v if isinstance(v, list) else np.full(len(at), np.nan) for v in stats], dtype=float)

    def _map(self, df: DataFrame, one: Callable[[Column, int], Column]) -> DataFrame:
        return replaced(df, {c: one(value(c), k) for k, c in enumerate(self.feature_names_in_)})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def partial_fit(self, df: DataFrame) -> None:
        raise NotImplementedError(f"{type(self).__name__} is fitted in one pass")

    def params_df(self, spark: object) -> DataFrame:
        """Fitted statistics, one row for each column."""
        own = {k: v for k, v in vars(self).items() if k.endswith("_") and isinstance(v, np.ndarray) and v.shape == (self.n_features_in_,)}
        rows = [(c, *[float(v[k]) for v in own.values()]) for k, c in enumerate(self.feature_names_in_)]
        return spark.createDataFrame(rows, ", ".join(["feature string", *[f"{k} double" for k in own]]))


class StandardScaler(_Columnwise):
    """Zero mean and unit population variance."""

    def __init__(self, columns: Sequence[str] | None = None, with_mean: bool = True, with_std: bool = True):
        self.columns, self.with_mean, self.with_std = columns, with_mean, with_std

    def fit(self, df: DataFrame) -> StandardScaler:
        stats = self._stats(df, {"mean": F.avg, "var": F.var_pop})
        self.mean_, self.var_ = (stats[s].astype(float) for s in ("mean", "var"))
        self.scale_ = nonzero_scale(np.sqrt(self.var_))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("scale_")
        shift = self.mean_ if self.with_mean else np.zeros(self.n_features_in_)
        scale = self.scale_ if self.with_std else np.ones(self.n_features_in_)
        return self._map(df, lambda x, k: (x - float(shift[k])) / float(scale[k]))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        shift = self.mean_ if self.with_mean else np.zeros(self.n_features_in_)
        scale = self.scale_ if self.with_std else np.ones(self.n_features_in_)
        return self._map(df, lambda x, k: x * float(scale[k]) + float(shift[k]))


class MinMaxScaler(_Columnwise):
    """Linear map of each column's range to ``feature_range``; nothing is clipped."""

    def __init__(self, feature_range: tuple[float, float] = (0, 1), columns: Sequence[str] | None = None):
        self.feature_range, self.columns = feature_range, columns

    def fit(self, df: DataFrame) -> MinMaxScaler:
        low, high = self.feature_range
        if low >= high:
            raise ValueError("Minimum of desired feature range must be smaller than maximum.")
        stats = self._stats(df, {"low": F.min, "high": F.max})
        self.data_min_, self.data_max_ = (stats[s].astype(float) for s in ("low", "high"))
        self.data_range_ = self.data_max_ - self.data_min_
        self.scale_ = (high - low) / nonzero_scale(self.data_range_)
        self.min_ = low - self.data_min_ * self.scale_
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("scale_")
        return self._map(df, lambda x, k: x * float(self.scale_[k]) + float(self.min_[k]))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda x, k: (x - float(self.min_[k])) / float(self.scale_[k]))


class RobustScaler(_Columnwise):
    """Median to zero, range between two percentiles to one.

    ``accuracy`` None computes exact percentiles, by ranks over ranges of values
    where a column has many; a number asks for ``percentile_approx`` of that accuracy.
    """

    def __init__(self, with_centering: bool = True, with_scaling: bool = True, quantile_range: tuple[float, float] = (25.0, 75.0), columns: Sequence[str] | None = None, accuracy: int | None = None):
        self.with_centering, self.with_scaling, self.quantile_range = with_centering, with_scaling, quantile_range
        self.columns, self.accuracy = columns, accuracy

    def fit(self, df: DataFrame) -> RobustScaler:
        low, high = self.quantile_range
        if not 0 <= low <= high <= 100:
            raise ValueError(f"quantile_range must be two percentages in ascending order, not {self.quantile_range}")
        q = self._percentiles(df, [low / 100, 0.5, high / 100], self.accuracy)
        self.center_, self.scale_ = q[:, 1], nonzero_scale(q[:, 2] - q[:, 0])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("scale_")
        shift = self.center_ if self.with_centering else np.zeros(self.n_features_in_)
        scale = self.scale_ if self.with_scaling else np.ones(self.n_features_in_)
        return self._map(df, lambda x, k: (x - float(shift[k])) / float(scale[k]))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        shift = self.center_ if self.with_centering else np.zeros(self.n_features_in_)
        scale = self.scale_ if self.with_scaling else np.ones(self.n_features_in_)
        return self._map(df, lambda x, k: x * float(scale[k]) + float(shift[k]))


class QuantileTransformer(_Columnwise):
    """Maps each column to a uniform or normal distribution through its quantiles."""

    EDGE = 1e-7

    def __init__(self, n_quantiles: int = 1000, output_distribution: str = "uniform", columns: Sequence[str] | None = None, accuracy: int | None = None):
        self.n_quantiles, self.output_distribution, self.columns, self.accuracy = n_quantiles, output_distribution, columns, accuracy

    def fit(self, df: DataFrame) -> QuantileTransformer:
        if self.output_distribution not in ("uniform", "normal"):
            raise ValueError(f"unknown output distribution {self.output_distribution!r}")
        self.references_ = np.linspace(0, 1, self.n_quantiles)
        self.quantiles_ = self._percentiles(df, self.references_, self.accuracy).T
        return self

    def _apply(self, df: DataFrame, inverse: bool) -> DataFrame:
        self.check_fitted("quantiles_")
        names, quantiles, references = self.feature_names_in_, self.quantiles_, self.references_
        normal, edge = self.output_distribution == "normal", self.EDGE
        lowest = NormalDist().inv_cdf(edge - np.spacing(1))

        def forward(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            # Mean of both directions, so that runs of equal quantiles map to their middle.
            y = 0.5 * (np.interp(x, q, references) - np.interp(-x, -q[::-1], -references[::-1]))
            slack = edge if normal else 0
            y[x - slack <= q[0]], y[x + slack >= q[-1]] = 0.0, 1.0
            if normal:
                y = np.array([np.clip(NormalDist().inv_cdf(min(max(p, 1e-300), 1 - 1e-16)), lowest, -lowest) for p in y])
            return y

        def backward(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            p = np.array([NormalDist().cdf(v) for v in x]) if normal else x
            y = np.interp(p, references, q)
            slack = edge if normal else 0
            y[p - slack <= 0], y[p + slack >= 1] = q[0], q[-1]
            return y

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, name in enumerate(names):
                    x = batch[name].to_numpy(dtype=float)
                    full = ~np.isnan(x)
                    y = np.full(len(x), np.nan)
                    y[full] = (backward if inverse else forward)(x[full], quantiles[:, k])
                    batch[name] = y
                yield batch

        schema = ", ".join(f"`{c}` {'double' if c in names else t}" for c, t in df.dtypes)
        return df.mapInPandas(run, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, False)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, True)


class PolynomialFeatures(_Columnwise):
    """Products of columns up to a degree, named ``1``, ``a``, ``a^2``, ``a b``."""

    def __init__(self, degree: int | tuple[int, int] = 2, interaction_only: bool = False, include_bias: bool = True, columns: Sequence[str] | None = None, preserve: bool = False):
        self.degree, self.interaction_only, self.include_bias, self.columns, self.preserve = degree, interaction_only, include_bias, columns, preserve

    def fit(self, df: DataFrame) -> PolynomialFeatures:
        low, high = (0, self.degree) if isinstance(self.degree, int) else self.degree
        if not (isinstance(low, int) and isinstance(high, int) and 0 <= low <= high):
            raise ValueError(f"degree must be an int or a pair min <= max, got {self.degree!r}")
        n = len(self._resolve(df))
        pick = combinations if self.interaction_only else combinations_with_replacement
        start = max(1, low)
        self.powers_ = list(chain.from_iterable(pick(range(n), d) for d in range(start, high + 1)))
        if self.include_bias and low == 0:
            self.powers_.insert(0, ())
        return self

    def get_feature_names_out(self) -> list[str]:
        def name(term: tuple[int, ...]) -> str:
            parts = [self.feature_names_in_[k] + (f"^{term.count(k)}" if term.count(k) > 1 else "") for k in dict.fromkeys(term)]
            return " ".join(parts) or "1"

        return [name(t) for t in self.powers_]

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("powers_")

        def product(term: tuple[int, ...]) -> Column:
            out = F.lit(1.0)
            for k in term:
                out = out * F.col(f"`{self.feature_names_in_[k]}`").cast("double")
            return out

        made = [product(t).alias(n) for t, n in zip(self.powers_, self.get_feature_names_out(), strict=True)]
        others = [F.col(f"`{c}`") for c in df.columns if c not in self.feature_names_in_] if self.preserve else []
        return df.select(*others, *made)


class BlockTransformer(Estimator):
    """A function of pandas frames applied to Arrow batches; ``schema`` None keeps the input's."""

    def __init__(self, func: Callable[..., pd.DataFrame], schema: str | None = None, validate: bool = False, kw_args: dict | None = None):
        self.func, self.schema, self.validate, self.kw_args = func, schema, validate, kw_args

    def fit(self, df: DataFrame | None = None) -> BlockTransformer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        func, extra = self.func, self.kw_args or {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield func(batch, **extra)

        return df.mapInPandas(run, self.schema or df.schema)

    fit_transform = transform


class SimpleImputer(_Columnwise):
    """Missing values become the mean, median, most frequent value or a constant.

    Of equally frequent values the smallest one is taken.
    """

    STRATEGIES = ("mean", "median", "most_frequent", "constant")

    def __init__(self, strategy: str = "mean", fill_value: object = None, columns: Sequence[str] | None = None, missing_values: object = None, add_indicator: bool = False, accuracy: int | None = None):
        self.strategy, self.fill_value, self.columns = strategy, fill_value, columns
        self.missing_values, self.add_indicator, self.accuracy = missing_values, add_indicator, accuracy

    def _present(self, name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            column = F.when(~F.isnan(column), column)
        return column if self.missing_values is None else F.when(column != F.lit(self.missing_values), column)

    def fit(self, df: DataFrame) -> SimpleImputer:
        if self.strategy not in self.STRATEGIES:
            raise ValueError(f"strategy {self.strategy!r} is none of {', '.join(self.STRATEGIES)}")
        if self.add_indicator:
            raise NotImplementedError("add_indicator")
        if self.missing_values is not None and self.strategy != "constant":
            raise ValueError("other missing values than NaN and NULL need strategy 'constant'")
        names, kinds = self._resolve(df), dict(df.dtypes)
        if self.strategy == "constant":
            default = {c: "missing_value" if kinds[c] == "string" else 0 for c in names}
            self.statistics_ = [default[c] if self.fill_value is None else self.fill_value for c in names]
            return self
        if self.strategy == "most_frequent":
            # Counted behind a shuffle, so that no task holds all values; of equals the smallest.
            self.statistics_ = []
            for c in names:
                top = df.select(self._present(c, kinds[c]).alias("v")).where("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").first()
                self.statistics_.append(None if top is None else top["v"])
            return self
        present = [self._present(c, kinds[c]) for c in names]
        if self.strategy == "median" and self.accuracy is None:
            found = exact_percentiles(df, present, [0.5], distinct_sizes(df, present))
            self.statistics_ = [None if v is None else v[0] for v in found]
            return self
        make = F.avg if self.strategy == "mean" else lambda c: F.percentile_approx(c, 0.5, self.accuracy)
        row = df.agg(*[make(c).alias(str(k)) for k, c in enumerate(present)]).first()
        self.statistics_ = [row[str(k)] for k in range(len(names))]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("statistics_")
        kinds = dict(df.dtypes)
        return replaced(df, {c: F.coalesce(self._present(c, kinds[c]), F.lit(s)) for c, s in zip(self.feature_names_in_, self.statistics_, strict=True)})
