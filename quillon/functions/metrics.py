"""Metrics as one aggregation: a float, or with ``compute=False`` a one-row frame ``value``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.base import value

EPS = 2.220446049250313e-16
Names = str | Sequence[str]


def _number(df: DataFrame, made: Column, compute: bool) -> float | DataFrame:
    out = df.agg(made.cast("double").alias("value"))
    return out.first()["value"] if compute else out


def _names(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _mean(x: Column, weight: str | None) -> Column:
    return F.avg(x) if weight is None else F.sum(x * value(weight)) / F.sum(value(weight))


def accuracy_score(df: DataFrame, y_true: Names, y_pred: Names, normalize: bool = True, sample_weight: str | None = None, compute: bool = True) -> float | DataFrame:
    """Share (or sum) of rows on which all columns agree; missing values agree with nothing."""
    hit = F.lit(True)
    for a, b in zip(_names(y_true), _names(y_pred), strict=True):
        hit = hit & (F.col(f"`{a}`") == F.col(f"`{b}`"))
    hit = F.coalesce(hit, F.lit(False)).cast("double")
    weight = F.lit(1.0) if sample_weight is None else value(sample_weight)
    return _number(df, _mean(hit, sample_weight) if normalize else F.sum(hit * weight), compute)


def log_loss(df: DataFrame, y_true: str, y_prob: str, labels: Sequence | None = None, eps: float = 1e-15, normalize: bool = True, sample_weight: str | None = None, compute: bool = True) -> float | DataFrame:
    """Cross entropy; ``y_prob`` is the probability of label 1, or an array in the order of ``labels``.

    Arrays are divided by their sums.
    """
    label = F.col(f"`{y_true}`")
    if dict(df.dtypes)[y_prob].startswith("array"):
        labels = sorted(labels) if labels is not None else sorted(r[0] for r in df.select(label).distinct().collect())
        clipped = F.transform(F.col(f"`{y_prob}`"), lambda p: F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1 - eps)))
        place = F.array_position(F.array(*map(F.lit, labels)), label).cast("int")
        p = F.element_at(clipped, place) / F.aggregate(clipped, F.lit(0.0), lambda s, x: s + x)
    else:
        p1 = F.least(F.greatest(value(y_prob), F.lit(eps)), F.lit(1 - eps))
        p = F.when(label.cast("double") == 1, p1).otherwise(1 - p1)
    loss = -F.log(p)
    weight = F.lit(1.0) if sample_weight is None else value(sample_weight)
    return _number(df, _mean(loss, sample_weight) if normalize else F.sum(loss * weight), compute)


def _regression(df: DataFrame, y_true: Names, y_pred: Names, one: Callable[[Column, Column], Column], multioutput: str, compute: bool, sample_weight: object, finish: Callable[[Column], Column] = lambda c: c) -> object:
    if sample_weight is not None:
        raise ValueError("'sample_weight' is not supported")
    if multioutput not in ("uniform_average", "raw_values"):
        raise ValueError("weighted 'multioutput' is not supported")
    parts = [finish(one(value(a), value(b))) for a, b in zip(_names(y_true), _names(y_pred), strict=True)]
    if multioutput == "raw_values":
        out = df.agg(F.array(*parts).alias("value"))
        return list(out.first()["value"]) if compute else out
    return _number(df, sum(parts[1:], parts[0]) / len(parts), compute)


def mean_squared_error(df: DataFrame, y_true: Names, y_pred: Names, sample_weight: object = None, multioutput: str = "uniform_average", squared: bool = True, compute: bool = True) -> object:
    finish = (lambda c: c) if squared else F.sqrt
    return _regression(df, y_true, y_pred, lambda a, b: F.avg((a - b) * (a - b)), multioutput, compute, sample_weight, finish)


def mean_absolute_error(df: DataFrame, y_true: Names, y_pred: Names, sample_weight: object = None, multioutput: str = "uniform_average", compute: bool = True) -> object:
    return _regression(df, y_true, y_pred, lambda a, b: F.avg(F.abs(a - b)), multioutput, compute, sample_weight)


def mean_absolute_percentage_error(df: DataFrame, y_true: Names, y_pred: Names, sample_weight: object = None, multioutput: str = "uniform_average", compute: bool = True, compat: bool = False) -> object:
    """Relative errors; ``compat`` divides by the target itself instead of its size, floored at epsilon."""
    size = (lambda a: a) if compat else F.abs
    return _regression(df, y_true, y_pred, lambda a, b: F.avg(F.abs(a - b) / F.greatest(size(a), F.lit(EPS))), multioutput, compute, sample_weight)


def mean_squared_log_error(df: DataFrame, y_true: Names, y_pred: Names, sample_weight: object = None, multioutput: str = "uniform_average", compute: bool = True) -> object:
    def one(a: Column, b: Column) -> Column:
        gap = F.log1p(a) - F.log1p(b)
        return F.avg(gap * gap)

    return _regression(df, y_true, y_pred, one, multioutput, compute, sample_weight)


def r2_score(df: DataFrame, y_true: Names, y_pred: Names, sample_weight: object = None, multioutput: str = "uniform_average", compute: bool = True) -> object:
    """1 without any error, 0 for a constant target that is missed."""
    if sample_weight is not None or multioutput != "uniform_average":
        raise NotImplementedError("only uniform averages without weights")

    def one(a: Column, b: Column) -> Column:
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        rest, spread = F.sum((a - b) * (a - b)), F.var_pop(a) * F.count(a)
        return F.when(rest == 0, 1.0).when(spread == 0, 0.0).otherwise(1 - rest / spread)

    return _regression(df, y_true, y_pred, one, multioutput, compute, None)


def poisson_deviance(df: DataFrame, y_true: str, y_pred: str, compute: bool = True) -> float | DataFrame:
    y, mu = value(y_true), value(y_pred)
    term = F.when(y == 0, 0.0).otherwise(y * F.log(y / mu))
    return _number(df, 2 * F.sum(term - (y - mu)), compute)


def _scorer(metric: Callable, prediction: str, sign: int = 1) -> Callable:
    def score(estimator: object, df: DataFrame, label: str) -> float:
        return sign * metric(estimator.predict(df), label, prediction)

    return score


def _proba_score(estimator: object, df: DataFrame, label: str) -> float:
    return -log_loss(estimator.predict_proba(df), label, "probability", labels=getattr(estimator, "classes_", None))


SCORERS: dict[str, Callable] = {
    "accuracy": _scorer(accuracy_score, "prediction"),
    "neg_mean_squared_error": _scorer(mean_squared_error, "prediction", -1),
    "r2": _scorer(r2_score, "prediction"),
    "neg_log_loss": _proba_score,
}
_METRICS = (accuracy_score, log_loss, mean_squared_error, mean_absolute_error, mean_absolute_percentage_error, mean_squared_log_error, r2_score)


def get_scorer(scoring: str | Callable) -> Callable:
    """A function of (estimator, df, label) by name; callables pass."""
    if isinstance(scoring, str):
        if scoring not in SCORERS:
            raise ValueError(f"{scoring!r} is not a valid scoring value. Valid options are {sorted(SCORERS)}")
        return SCORERS[scoring]
    return scoring


def check_scoring(estimator: object, scoring: str | Callable | None = None) -> Callable:
    if scoring in _METRICS or isinstance(scoring, partial):
        raise ValueError("scoring value looks like it is a metric function rather than a scorer")
    if scoring is None:
        if not hasattr(estimator, "score"):
            raise TypeError(f"estimator {estimator!r} has no 'score' method")
        return lambda est, df, label: est.score(df, label)
    return get_scorer(scoring)
