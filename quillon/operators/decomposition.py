"""Principal components and truncated SVD from sums of outer products.

Tasks sum x and x*x' over Arrow batches in NumPy; the driver decomposes the
d*d matrix.  Signs are fixed: each component's entry of largest size is positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.base import Estimator, Features, dot, literal, partial_sums, project, projected, vector, width


def flip_signs(components: np.ndarray) -> np.ndarray:
    at = np.abs(components).argmax(axis=1)
    return components * np.sign(components[np.arange(len(components)), at])[:, None]


def moments(df: DataFrame, features: Features) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, centred sum of outer products).

    Sums are taken around the first row, so that large means cost no digits.
    """
    d = width(df, features)
    x = vector(features)
    row = df.select(x.alias("x")).where("x IS NOT NULL").first()
    if row is None:
        raise ValueError("Found array with 0 sample(s)")
    origin = np.array(row["x"], dtype=float)

    def batch(values: np.ndarray) -> np.ndarray:
        values = values - origin
        return np.concatenate(([len(values)], values.sum(0), (values.T @ values).ravel()))

    out = partial_sums(df.select(x.alias("x")).where("x IS NOT NULL"), [F.col("x")], batch, 1 + d + d * d)
    n, total, outer = int(out[0]), out[1 : 1 + d], out[1 + d :].reshape(d, d)
    return n, origin + total / n, outer - np.outer(total, total) / n


class PCA(Estimator):
    """Principal components from the exact covariance matrix, which one pass adds up.

    All of ``svd_solver``'s values give these same, exact components; ``tol``,
    ``iterated_power`` and ``random_state`` are taken for the call's sake and
    change nothing.
    """

    def __init__(self, n_components: int | None = None, whiten: bool = False, svd_solver: str = "auto", tol: float = 0.0, iterated_power: int = 0, random_state: int | None = None):
        self.n_components, self.whiten, self.svd_solver = n_components, whiten, svd_solver
        self.tol, self.iterated_power, self.random_state = tol, iterated_power, random_state

    def fit(self, df: DataFrame, features: Features) -> PCA:
        if not isinstance(df, DataFrame):
            raise TypeError("Cannot fit PCA on an object that isn't a DataFrame")
        if self.svd_solver not in ("auto", "full", "tsqr", "randomized"):
            raise ValueError(f"Invalid solver {self.svd_solver!r}")
        n, mean, outer = moments(df, features)
        d = len(mean)
        k = min(n, d) if self.n_components is None else self.n_components
        if isinstance(k, float) and not k.is_integer():
            raise NotImplementedError("fractional 'n_components' is not supported")
        if not 1 <= k <= min(n, d):
            raise ValueError(f"n_components={k} must be between 1 and min(n_samples, n_features)={min(n, d)}")
        values, vectors = np.linalg.eigh(outer)
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        variance = values / max(n - 1, 1)
        self.features_, self.n_samples_, self.n_features_in_, self.n_components_ = features, n, d, int(k)
        self.mean_, self.components_ = mean, flip_signs(vectors[:k])
        self.explained_variance_ = variance[:k]
        self.explained_variance_ratio_ = variance[:k] / variance.sum() if variance.sum() else np.zeros(k)
        self.singular_values_ = np.sqrt(values[:k])
        self.noise_variance_ = float(variance[k:].mean()) if k < min(n, d) else 0.0
        return self

    def transform(self, df: DataFrame, output: str = "pca") -> DataFrame:
        self.check_fitted("components_")
        components = self.components_ / np.sqrt(np.maximum(self.explained_variance_, 1e-300))[:, None] if self.whiten else self.components_
        return projected(df, self.features_, components, self.mean_, output)

    def fit_transform(self, df: DataFrame, features: Features, output: str = "pca") -> DataFrame:
        return self.fit(df, features).transform(df, output)

    def inverse_transform(self, df: DataFrame, column: str = "pca", output: str = "restored") -> DataFrame:
        components = self.components_ * np.sqrt(self.explained_variance_)[:, None] if self.whiten else self.components_
        out = projected(df, column, components.T, None, output)
        return out.withColumn(output, F.zip_with(F.col(f"`{output}`"), literal(self.mean_), lambda x, m: x + m))

    def get_covariance(self) -> np.ndarray:
        excess = np.maximum(self.explained_variance_ - self.noise_variance_, 0)
        return self.components_.T * excess @ self.components_ + self.noise_variance_ * np.eye(self.n_features_in_)

    def score_samples(self, df: DataFrame, output: str = "log_likelihood") -> DataFrame:
        """Log-likelihood under the probabilistic model."""
        precision = np.linalg.pinv(self.get_covariance())
        _, logdet = np.linalg.slogdet(self.get_covariance())
        centred = F.zip_with(vector(self.features_), literal(self.mean_), lambda x, m: x - m)
        quadratic = dot(centred, project(centred, precision))
        return df.withColumn(output, -0.5 * quadratic - F.lit(0.5 * (self.n_features_in_ * np.log(2 * np.pi) + logdet)))

    def score(self, df: DataFrame) -> float:
        return self.score_samples(df, "__score").agg(F.avg("__score")).first()[0]


def incremental_mean_and_var(x: np.ndarray, last_mean: np.ndarray, last_var: np.ndarray, last_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged means, population variances and counts; NaN is ignored."""
    count = (~np.isnan(x)).sum(0)
    mean = np.where(count, np.nansum(x, axis=0) / np.maximum(count, 1), 0)
    spread = np.nansum((x - mean) ** 2, axis=0)
    total = last_count + count
    gap = mean - last_mean
    new = last_mean + gap * count / np.maximum(total, 1)
    spread = last_var * last_count + spread + gap**2 * last_count * count / np.maximum(total, 1)
    return new, spread / np.maximum(total, 1), total


class IncrementalPCA(PCA):
    """PCA from batches in turn; ``fit`` streams batches of a frame through ``partial_fit``."""

    def __init__(self, n_components: int | None = None, whiten: bool = False, batch_size: int | None = None, svd_solver: str = "auto"):
        self.n_components, self.whiten, self.batch_size, self.svd_solver = n_components, whiten, batch_size, svd_solver

    def fit(self, df: DataFrame, features: Features) -> IncrementalPCA:
        for name in ("components_", "n_samples_seen_"):
            vars(self).pop(name, None)
        d = width(df, features)
        size, held = self.batch_size or 5 * d, []
        for row in df.select(vector(features).alias("x")).toLocalIterator():
            held.append(row["x"])
            if len(held) >= size + (self.n_components or d):  # what is left at the end is large enough for a batch
                self.partial_fit(np.array(held[:size]))
                held = held[size:]
        self.partial_fit(np.array(held))
        self.features_ = features
        return self

    def partial_fit(self, x: np.ndarray) -> IncrementalPCA:
        if not isinstance(x, np.ndarray):
            raise TypeError("partial_fit takes a NumPy array")
        n, d = x.shape
        first = not hasattr(self, "components_")
        k = min(n, d) if self.n_components is None and first else (self.n_components if self.n_components is not None else len(self.components_))
        if not 1 <= k <= d:
            raise ValueError(f"n_components={k} invalid for n_features={d}")
        if first and k > n:
            raise ValueError(f"n_components={k} must be less or equal to the batch number of samples {n}")
        if first:
            self.n_samples_seen_, self.mean_, self.var_ = 0, np.zeros(d), np.zeros(d)
        elif len(self.components_) != k:
            raise ValueError("Number of input features has changed between calls to partial_fit")
        mean, var, total = incremental_mean_and_var(x, self.mean_, self.var_, np.full(d, self.n_samples_seen_))
        if first:
            stack = x - mean
        else:
            own = x.mean(0)
            correction = np.sqrt(self.n_samples_seen_ * n / total[0]) * (self.mean_ - own)
            stack = np.vstack((self.singular_values_[:, None] * self.components_, x - own, correction))
        _, s, vt = np.linalg.svd(stack, full_matrices=False)
        vt = flip_signs(vt)
        self.n_samples_seen_ = self.n_samples_ = int(total[0])
        self.components_, self.singular_values_, self.mean_, self.var_ = vt[:k], s[:k], mean, var
        variance = s**2 / max(self.n_samples_seen_ - 1, 1)
        self.explained_variance_ = variance[:k]
        self.explained_variance_ratio_ = s[:k] ** 2 / max((var * total).sum(), 1e-300)
        self.noise_variance_ = float(variance[k:].mean()) if k < len(variance) and k < d else 0.0
        self.n_components_, self.n_features_in_ = k, d
        return self


class TruncatedSVD(Estimator):
    """Leading right singular vectors without centring."""

    def __init__(self, n_components: int = 2, algorithm: str = "tsqr", n_iter: int = 5, random_state: int | None = None, tol: float = 0.0):
        self.n_components, self.algorithm, self.n_iter, self.random_state, self.tol = n_components, algorithm, n_iter, random_state, tol

    def fit(self, df: DataFrame, features: Features) -> TruncatedSVD:
        if self.algorithm not in ("tsqr", "randomized"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        n, mean, outer = moments(df, features)
        if self.n_components >= len(mean):
            raise ValueError(f"n_components must be < n_features; got {self.n_components} >= {len(mean)}")
        values, vectors = np.linalg.eigh(outer + n * np.outer(mean, mean))
        order = np.argsort(-values)[: self.n_components]
        self.features_, self.components_ = features, flip_signs(vectors[:, order].T)
        self.singular_values_ = np.sqrt(np.maximum(values[order], 0))
        self.explained_variance_ = np.einsum("ij,jk,ik->i", self.components_, outer / n, self.components_)
        self.explained_variance_ratio_ = self.explained_variance_ / (np.trace(outer) / n)
        return self

    def transform(self, df: DataFrame, output: str = "svd") -> DataFrame:
        self.check_fitted("components_")
        return projected(df, self.features_, self.components_, None, output)

    def fit_transform(self, df: DataFrame, features: Features, output: str = "svd") -> DataFrame:
        return self.fit(df, features).transform(df, output)

    def inverse_transform(self, df: DataFrame, column: str = "svd", output: str = "restored") -> DataFrame:
        return projected(df, column, self.components_.T, None, output)
