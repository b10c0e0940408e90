"""k-means with scalable initialisation, and spectral clustering by the Nyström method.

An iteration is one aggregation of k*(d+1)+1 numbers; rows are cached once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import pairwise
from quillon.operators.base import Estimator, Features, matrix, partial_sums, vector, width


#: Share of the largest eigenvalue below which a kernel's eigenvalues count as zero.
CUT = 1e-10


def _near(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def kmeans_pp(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """k-means++ on a small matrix."""
    weight = np.ones(len(x)) if weight is None else weight
    centers = [x[rng.choice(len(x), p=weight / weight.sum())]]
    while len(centers) < k:
        d = _near(x, np.array(centers))[1] * weight
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centers)


def lloyd(x: np.ndarray, centers: np.ndarray, steps: int = 100) -> np.ndarray:
    for _ in range(steps):
        label, _ = _near(x, centers)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(len(centers))])
        if np.allclose(new, centers):
            break
        centers = new
    return centers


class KMeans(Estimator):
    """Lloyd's algorithm; ``init`` is k-means||, k-means++, random or an array of centers.

    k-means++ sees all rows, in two passes for each center; k-means|| needs fewer.

    ``inertia_`` is the sum of plain distances to the centers, as ``compat``
    asks for, or else of squared ones.  ``key`` names a column that tells rows
    apart for random choices (a hash of the features if None).
    """

    def __init__(self, n_clusters: int = 8, init: str | np.ndarray = "k-means||", oversampling_factor: float = 2, max_iter: int = 300, tol: float = 1e-4, random_state: int = 0, init_max_iter: int | None = None, key: str | None = None, compat: bool = False):
        self.n_clusters, self.init, self.oversampling_factor, self.max_iter = n_clusters, init, oversampling_factor, max_iter
        self.tol, self.random_state, self.init_max_iter, self.key, self.compat = tol, random_state, init_max_iter, key, compat

    def _check(self, rows: DataFrame) -> int:
        bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.coalesce(bad, F.lit(True))), F.lit(False)).alias("bad")).first()
        if not row["n"]:
            raise ValueError("Found array with 0 sample(s)")
        if row["bad"]:
            raise ValueError("Input contains NaN, infinity or a value too large")
        if row["n"] < self.n_clusters:
            raise ValueError(f"n_samples={row['n']} should be >= n_clusters={self.n_clusters}")
        return row["n"]

    def fit(self, df: DataFrame, features: Features) -> KMeans:
        self.features_ = features
        who = F.xxhash64(F.col(f"`{self.key}`")) if self.key else F.xxhash64(vector(features))
        rows = df.select(vector(features).alias("x"), who.alias("id")).persist()
        try:
            n = self._check(rows)
            d = width(df, features)
            centers = self._start(rows, n, d)
            self._iterate(rows, centers)
        finally:
            rows.unpersist()
        return self

    def _draw(self, rows: DataFrame, n: int, seed: int) -> np.ndarray:
        picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()
        return np.array([r["x"] for r in picked])

    def _plus_plus(self, rows: DataFrame, k: int) -> np.ndarray:
        """Greedy k-means++ over all rows: a pass draws candidates by squared distance, another takes the best of them.

        The row with the smallest -log(u) / weight is drawn with a chance in
        proportion to its weight; equal rows are one with their number as weight.
        """
        points = rows.groupBy("id", "x").agg(F.count(F.lit(1)).cast("double").alias("n")).persist()
        trials = 2 + int(np.log(k))

        def drawn(at: np.ndarray | None, r: int) -> np.ndarray:
            tries = trials if at is not None else 1
            u = [F.shiftrightunsigned(F.xxhash64("id", "x", F.lit(self.random_state), F.lit(r), F.lit(t)), 11).cast("double") for t in range(tries)]

            def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                found: dict[int, tuple[float, list]] = {}
                for batch in batches:
                    if not len(batch):
                        continue
                    weight = batch["n"].to_numpy()
                    if at is not None:
                        weight = weight * _near(matrix(batch["x"]), at)[1]
                    chance = matrix(batch["u"])
                    for t in range(tries):
                        race = np.where(weight > 0, -np.log((chance[:, t] + 0.5) / (1 << 53)) / np.where(weight > 0, weight, 1), np.inf)
                        low = int(race.argmin())
                        if race[low] < np.inf:
                            found[t] = min(found.get(t, (np.inf, [])), (float(race[low]), [float(v) for v in batch["x"].iloc[low]]))
                if found:
                    yield pd.DataFrame({"t": list(found), "race": [f[0] for f in found.values()], "x": [f[1] for f in found.values()]})

            made = points.select("x", "n", F.array(*u).alias("u")).mapInPandas(best, "t int, race double, x array<double>")
            rows_ = made.groupBy("t").agg(F.min(F.struct("race", "x")).alias("of")).orderBy("t").collect()  # ``tries`` rows
            return np.array([r_["of"]["x"] for r_ in rows_])

        try:
            centers = drawn(None, 0)
            while len(centers) < k:
                found = drawn(centers, len(centers))
                if not len(found):
                    return np.concatenate((centers, self._draw(rows, k - len(centers), self.random_state + 1)))
                at = centers

                def costs(x: np.ndarray, n: np.ndarray, at: np.ndarray = at, found: np.ndarray = found) -> np.ndarray:
                    near = _near(x, at)[1]
                    return np.array([(n * np.minimum(near, _near(x, c[None])[1])).sum() for c in found])

                left = partial_sums(points, [F.col("x"), F.col("n")], costs, len(found))
                centers = np.concatenate((centers, found[[int(left.argmin())]]))
            return centers
        finally:
            points.unpersist()

    def _start(self, rows: DataFrame, n: int, d: int) -> np.ndarray:
        rng, k = np.random.default_rng(self.random_state), self.n_clusters
        if isinstance(self.init, np.ndarray):
            if self.init.shape != (k, d):
                raise ValueError(f"The shape of the initial centers {self.init.shape} does not match {(k, d)}")
            return self.init.astype(float)
        if self.init == "random":
            return self._draw(rows, k, self.random_state)
        if self.init == "k-means++":
            return self._plus_plus(rows, k)
        if self.init != "k-means||":
            raise (ValueError if isinstance(self.init, str) else TypeError)(f"'init' must be 'k-means||', 'k-means++', 'random' or an array, got {self.init!r}")
        centers = self._draw(rows, 1, self.random_state)

        def cost(at: np.ndarray) -> float:
            return partial_sums(rows, [F.col("x")], lambda x: np.array([_near(x, at)[1].sum()]), 1)[0]

        phi = cost(centers)
        rounds = max(1, round(np.log(phi))) if phi > 1 else 1
        for r in range(min(rounds, self.init_max_iter) if self.init_max_iter is not None else rounds):
            if phi <= 0:
                break
            at, chance = centers, self.oversampling_factor * k / phi
            drawn = F.shiftrightunsigned(F.xxhash64("id", F.lit(self.random_state), F.lit(r)), 11).cast("double") / float(1 << 53)

            def pick(batches: Iterator[pd.DataFrame], at: np.ndarray = at, chance: float = chance) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if len(batch):
                        yield batch[["x"]][(batch["u"].to_numpy() < chance * _near(matrix(batch["x"]), at)[1])]

            new = rows.select("x", drawn.alias("u")).mapInPandas(pick, "x array<double>").collect()  # about oversampling * k rows
            if new:
                centers = np.concatenate((centers, np.array([r_["x"] for r_ in new])))
                phi = cost(centers)
        if len(centers) < k:
            return np.concatenate((centers, self._draw(rows, k - len(centers), self.random_state + 1)))
        weight = partial_sums(rows, [F.col("x")], lambda x: np.bincount(_near(x, centers)[0], minlength=len(centers)).astype(float), len(centers))
        return lloyd(centers, kmeans_pp(centers, k, rng, np.maximum(weight, 1e-9)))

    def _iterate(self, rows: DataFrame, centers: np.ndarray) -> None:
        k, d = centers.shape
        self.n_iter_ = 0

        def step(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            label, dist = _near(x, at)
            sums = np.zeros((k, d))
            np.add.at(sums, label, x)
            return np.concatenate((sums.ravel(), np.bincount(label, minlength=k), [dist.sum(), np.sqrt(dist).sum()]))

        for self.n_iter_ in range(1, self.max_iter + 1):
            out = partial_sums(rows, [F.col("x")], lambda x, at=centers: step(x, at), k * d + k + 2)
            counts = out[k * d : k * d + k]
            new = out[: k * d].reshape(k, d) / np.maximum(counts, 1)[:, None]
            shift = ((new - centers) ** 2).sum()
            if shift < self.tol:
                break
            centers = new
        out = partial_sums(rows, [F.col("x")], lambda x: step(x, centers), k * d + k + 2)
        self.cluster_centers_, self.inertia_ = centers, float(out[-1] if self.compat else out[-2])

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        self.check_fitted("cluster_centers_")
        found = pairwise.pairwise_distances_argmin_min(df, self.features_, self.cluster_centers_, index=output, distance="__distance")
        return found.drop("__distance")

    def transform(self, df: DataFrame, output: str = "distances") -> DataFrame:
        self.check_fitted("cluster_centers_")
        return pairwise.euclidean_distances(df, self.features_, self.cluster_centers_, output=output)

    def fit_predict(self, df: DataFrame, features: Features) -> DataFrame:
        return self.fit(df, features).predict(df)


def k_means(df: DataFrame, features: Features, n_clusters: int, return_n_iter: bool = False, **kw: object) -> tuple:
    """(labelled frame, centers, inertia[, iterations])."""
    model = KMeans(n_clusters, **kw).fit(df, features)
    out = (model.predict(df), model.cluster_centers_, model.inertia_)
    return (*out, model.n_iter_) if return_n_iter else out


class SpectralClustering(Estimator):
    """Nyström embedding from ``n_components`` sampled rows, then k-means on it."""

    def __init__(self, n_clusters: int = 8, gamma: float | None = 1.0, affinity: str = "rbf", degree: int = 3, coef0: float = 1, n_components: int = 100, random_state: int = 0, kmeans_params: dict | None = None, key: str | None = None, kernel_params: dict | None = None):
        self.n_clusters, self.gamma, self.affinity, self.degree, self.coef0 = n_clusters, gamma, affinity, degree, coef0
        self.n_components, self.random_state, self.kmeans_params, self.key, self.kernel_params = n_components, random_state, kmeans_params, key, kernel_params

    def _kernel(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        g = self.gamma if self.gamma is not None else 1 / x.shape[1]
        if callable(self.affinity):
            return self.affinity(x, y, **(self.kernel_params or {}))
        if self.affinity == "rbf":
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)
            return np.exp(-g * d)
        product = x @ y.T
        return {"linear": lambda: product, "polynomial": lambda: (g * product + self.coef0) ** self.degree, "poly": lambda: (g * product + self.coef0) ** self.degree, "sigmoid": lambda: np.tanh(g * product + self.coef0)}[self.affinity]()

    def fit_predict(self, df: DataFrame, features: Features) -> DataFrame:
        if not callable(self.affinity) and self.affinity not in pairwise.KERNELS:
            raise ValueError(f"Unknown affinity metric name {self.affinity!r}. Expected one of {sorted(pairwise.KERNELS)}")
        n = df.count()
        if n <= self.n_components:
            raise ValueError(f"'n_components' must be smaller than the number of samples. Got {self.n_components} components and {n} samples")
        order = F.xxhash64(F.col(f"`{self.key}`"), F.lit(self.random_state)) if self.key else F.xxhash64(vector(features), F.lit(self.random_state))
        keep = np.array([r["x"] for r in df.select(vector(features).alias("x"), order.alias("o")).orderBy("o").limit(self.n_components).collect()])
        m, k, kernel = len(keep), self.n_clusters, self._kernel
        a = kernel(keep, keep)
        total = partial_sums(df, [vector(features)], lambda x: kernel(keep, x).sum(1), m)
        pull = np.linalg.pinv(a, rcond=CUT, hermitian=True) @ (total - a.sum(1))
        d1 = 1 / np.sqrt(np.maximum(total, 1e-12))

        def scaled(x: np.ndarray) -> np.ndarray:
            """Degree-normalised kernel with the sampled rows."""
            b = kernel(x, keep)
            return b * d1 / np.sqrt(np.maximum(b.sum(1) + b @ pull, 1e-12))[:, None]

        # Eigenvectors of the completed kernel: those of A^-1/2 (sum of c c') A^-1/2, one more pass.
        values, vectors = np.linalg.eigh(d1[:, None] * a * d1)
        full = values > CUT * values.max()
        half = (vectors[:, full] / np.sqrt(values[full])) @ vectors[:, full].T
        outer = partial_sums(df, [vector(features)], lambda x: (scaled(x).T @ scaled(x)).ravel(), m * m).reshape(m, m)
        s, u = np.linalg.eigh(half @ outer @ half)
        s, u = s[::-1][:k], u[:, ::-1][:, :k]
        basis = half @ u / np.sqrt(np.maximum(s, 1e-12))
        rows = df.withColumn("__embedding", vector(features))

        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    e = scaled(matrix(batch["__embedding"])) @ basis
                    batch["__embedding"] = list(e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12))
                yield batch

        self.embedding_ = rows.mapInPandas(embed, rows.schema)
        self.assign_labels_ = KMeans(k, random_state=self.random_state, **(self.kmeans_params or {})).fit(self.embedding_, "__embedding")
        self.eigenvalues_ = s
        return self.assign_labels_.predict(self.embedding_).drop("__embedding")

    fit = fit_predict
