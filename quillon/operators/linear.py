"""Generalised linear models and Gaussian naive Bayes.

Rows are packed into matrices once and kept; every solver step is one aggregation:
gradients and Hessians are summed over these in NumPy and added up position by
position; the driver holds d*d numbers.  The objective is the sum of losses plus a penalty of 1/C on all
coefficients, the intercept included.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators.base import Estimator, Features, dot, kept_packed, literal, packed_sums, vector, width

SOLVERS = ("admm", "proximal_grad", "lbfgs", "newton", "gradient_descent")


class Penalty:
    """Elastic net: ``l1`` share of absolute values, the rest half squares."""

    def __init__(self, l1: float):
        self.l1 = l1

    def smooth(self, b: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
        return lam * (1 - self.l1) * (b @ b) / 2, lam * (1 - self.l1) * b

    def value(self, b: np.ndarray, lam: float) -> float:
        return self.smooth(b, lam)[0] + lam * self.l1 * np.abs(b).sum()

    def prox(self, b: np.ndarray, lam: float, t: float) -> np.ndarray:
        return np.sign(b) * np.maximum(np.abs(b) - t * lam * self.l1, 0) / (1 + t * lam * (1 - self.l1))


PENALTIES = {"l1": Penalty(1.0), "l2": Penalty(0.0), "elastic_net": Penalty(0.5)}


def add_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    """A first column of ones."""
    if name in df.columns:
        raise ValueError(f"the frame has a column {name!r} already")
    return df.select(F.lit(1.0).alias(name), "*")


class _GLM(Estimator):
    family: str

    def __init__(self, penalty: str | Penalty = "l2", tol: float = 1e-4, C: float = 1.0, fit_intercept: bool = True, solver: str = "admm", max_iter: int = 100, solver_kwargs: dict | None = None):
        self.penalty, self.tol, self.C, self.fit_intercept = penalty, tol, C, fit_intercept
        self.solver, self.max_iter, self.solver_kwargs = solver, max_iter, solver_kwargs

    def fit(self, df: DataFrame, features: Features, label: str) -> _GLM:
        if self.solver not in SOLVERS:
            raise ValueError(f"'solver' must be one of {SOLVERS}. Got {self.solver!r} instead")
        penalty = PENALTIES.get(self.penalty, self.penalty) if isinstance(self.penalty, str) else self.penalty
        if not isinstance(penalty, Penalty):
            raise ValueError(f"unknown penalty {self.penalty!r}")
        self.features_, self.label_ = features, label
        self.n_features_in_ = width(df, features)
        rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        rows = kept_packed(rows, self.fit_intercept)
        try:
            beta = _Solver(self, rows, penalty).run()
        finally:
            rows.unpersist()
        self.coef_ = beta[:-1] if self.fit_intercept else beta
        self.intercept_ = float(beta[-1]) if self.fit_intercept else 0.0
        return self

    def _eta(self) -> Column:
        self.check_fitted("coef_")
        return dot(vector(self.features_), literal(self.coef_)) + F.lit(self.intercept_)


class _Solver:
    def __init__(self, model: _GLM, rows: DataFrame, penalty: Penalty):
        self.rows, self.family = rows, model.family
        self.penalty, self.lam, self.tol, self.steps, self.kind = penalty, 1 / model.C, model.tol, model.max_iter, model.solver
        self.d = model.n_features_in_ + model.fit_intercept
        self.extra = model.solver_kwargs or {}

    def sums(self, beta: np.ndarray, hessian: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian of all rows."""
        d, family = self.d, self.family

        def batch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            eta = x @ beta
            if family == "logistic":
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                loss, slope, curve = np.logaddexp(0, eta) - y * eta, p - y, p * (1 - p)
            elif family == "poisson":
                mu = np.exp(np.clip(eta, -500, 500))
                loss, slope, curve = mu - y * eta, mu - y, mu
            else:
                loss, slope, curve = (eta - y) ** 2, 2 * (eta - y), np.full(len(y), 2.0)
            parts = [[loss.sum()], x.T @ slope]
            if hessian:
                parts.append((x.T @ (x * curve[:, None])).ravel())
            return np.concatenate(parts)

        out = packed_sums(self.rows, batch, 1 + d + d * d * hessian)
        return out[0], out[1 : 1 + d], out[1 + d :].reshape(d, d) if hessian else np.zeros((0, 0))

    def run(self) -> np.ndarray:
        return getattr(self, self.kind)(np.zeros(self.d))

    def _newton(self, beta: np.ndarray, extra: object = None, steps: int | None = None) -> np.ndarray:
        """Damped Newton on the losses plus ``extra(beta)`` -> (value, gradient, Hessian)."""
        extra = extra or (lambda b: (0.0, np.zeros_like(b), np.zeros((len(b), len(b)))))
        f, g, h = (a + b for a, b in zip(self.sums(beta, True), extra(beta), strict=True))
        for _ in range(steps or self.steps):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            scale = 1.0
            while True:
                new = beta - scale * step
                f2, g2, h2 = (a + b for a, b in zip(self.sums(new, True), extra(new), strict=True))
                if f2 <= f + 1e-12 * abs(f) or scale < 1e-6:
                    break
                scale /= 2
            done = np.linalg.norm(new - beta) <= self.tol * 1e-2 * max(1.0, np.linalg.norm(beta))
            beta, f, g, h = new, f2, g2, h2
            if done:
                break
        return beta

    def newton(self, beta: np.ndarray) -> np.ndarray:
        return self._newton(beta)

    def gradient_descent(self, beta: np.ndarray) -> np.ndarray:
        """Backtracking descent, preconditioned by the Hessian's diagonal at the start; no penalty."""
        return self._descend(beta, lambda b: (0.0, np.zeros_like(b)), lambda b, t: b)

    def proximal_grad(self, beta: np.ndarray) -> np.ndarray:
        return self._descend(beta, lambda b: (0.0, np.zeros_like(b)), lambda b, t: self.penalty.prox(b, self.lam, t))

    def _descend(self, beta: np.ndarray, smooth: object, prox: object) -> np.ndarray:
        f, g, h = self.sums(beta, True)
        step = 1 / max(np.linalg.norm(h, 2), 1e-12)
        momentum, previous = 1.0, beta
        for _ in range(self.steps * 5):
            nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            at = beta + (momentum - 1) / nxt * (beta - previous)
            f, g, _ = self.sums(at, False)
            while True:
                new = prox(at - step * g, step)
                gap = new - at
                if self.sums(new, False)[0] <= f + g @ gap + gap @ gap / (2 * step) + 1e-9 * abs(f) or step < 1e-15:
                    break
                step /= 2
            if np.linalg.norm(new - beta) <= self.tol * 1e-2 * max(1.0, np.linalg.norm(beta)):
                return new
            if (at - new) @ (new - beta) > 0:
                nxt = 1.0
            previous, beta, momentum = beta, new, nxt
        return beta

    def lbfgs(self, beta: np.ndarray, memory: int = 10) -> np.ndarray:
        """Limited-memory BFGS on the losses plus the smooth part of the penalty."""
        if self.penalty.l1:
            return self.proximal_grad(beta)

        def at(b: np.ndarray) -> tuple[float, np.ndarray]:
            f, g, _ = self.sums(b, False)
            p, q = self.penalty.smooth(b, self.lam)
            return f + p, g + q

        f, g = at(beta)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.steps):
            if np.linalg.norm(g) <= self.tol * 1e-2 * max(1.0, abs(f)):
                break
            q, alphas = g.copy(), []
            for s, y in reversed(pairs):
                alphas.append(s @ q / (y @ s))
                q -= alphas[-1] * y
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1e-12)
            for (s, y), a in zip(pairs, reversed(alphas), strict=True):
                q += s * (a - y @ q / (y @ s))
            t = 1.0
            while True:
                new = beta - t * q
                f2, g2 = at(new)
                if f2 <= f - 1e-4 * t * (g @ q) or t < 1e-10:
                    break
                t /= 2
            s, y = new - beta, g2 - g
            if s @ y > 1e-12:
                pairs = [*pairs, (s, y)][-memory:]
            beta, f, g = new, f2, g2
        return beta

    def admm(self, beta: np.ndarray) -> np.ndarray:
        """Losses by Newton, penalty by its proximal map, tied by a scaled dual."""
        rho, z, u = self.extra.get("rho", 1.0), beta.copy(), np.zeros_like(beta)
        eye = np.eye(len(beta))
        for _ in range(self.steps):
            beta = self._newton(beta, lambda b: (rho / 2 * ((b - z + u) @ (b - z + u)), rho * (b - z + u), rho * eye), 3)
            old, z = z, self.penalty.prox(beta + u, self.lam, 1 / rho)
            u += beta - z
            primal, dual = np.linalg.norm(beta - z), rho * np.linalg.norm(z - old)
            if max(primal, dual) <= self.tol * max(1.0, np.linalg.norm(z)):
                break
            if primal > 10 * dual:
                rho, u = rho * 2, u / 2
            elif dual > 10 * primal:
                rho, u = rho / 2, u * 2
        return z


class LogisticRegression(_GLM):
    """Two classes; ``prediction`` is boolean, ``probability`` an array of both."""

    family = "logistic"
    classes_ = (False, True)

    def decision_function(self, df: DataFrame) -> DataFrame:
        return df.withColumn("decision", self._eta())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-self._eta()))
        return df.withColumn("probability", F.array(1 - p, p))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._eta() > 0)

    def score(self, df: DataFrame, label: str) -> float:
        out = self.predict(df).withColumn("prediction", F.col("prediction").cast("int"))
        return metrics.accuracy_score(out.withColumn("__y", F.col(f"`{label}`").cast("int")), "__y", "prediction")


class LinearRegression(_GLM):
    family = "normal"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._eta())

    def score(self, df: DataFrame, label: str) -> float:
        return metrics.r2_score(self.predict(df), label, "prediction")


class PoissonRegression(_GLM):
    family = "poisson"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.exp(self._eta()))

    def get_deviance(self, df: DataFrame, label: str) -> float:
        return metrics.poisson_deviance(self.predict(df), label, "prediction")

    def score(self, df: DataFrame, label: str) -> float:
        return -self.get_deviance(df, label)


def logsumexp(values: Column) -> Column:
    """Shifted by the maximum."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


class GaussianNB(Estimator):
    """Means and population variances of each class in one aggregation; no smoothing."""

    def __init__(self, priors: Sequence[float] | None = None, classes: Sequence | None = None):
        self.priors, self.classes = priors, classes

    def fit(self, df: DataFrame, features: Features, label: str) -> GaussianNB:
        d = width(df, features)
        x = vector(features)
        stats = [a(x[k]).alias(f"{n}{k}") for n, a in (("m", F.avg), ("v", F.var_pop)) for k in range(d)]
        rows = df.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`").alias("y")).agg(F.count(F.lit(1)).alias("n"), *stats).collect()
        rows.sort(key=lambda r: r["y"])
        if self.classes is not None:
            rows = [r for r in rows if r["y"] in set(self.classes)]
        self.features_, self.label_ = features, label
        self.classes_ = [r["y"] for r in rows]
        self.counts_ = np.array([r["n"] for r in rows])
        self.theta_, self.sigma_ = (np.array([[r[f"{n}{k}"] for k in range(d)] for r in rows], dtype=float) for n in ("m", "v"))
        self.class_prior_ = self.counts_ / self.counts_.sum()
        return self

    def _joint(self) -> Column:
        self.check_fitted("theta_")
        x, out = vector(self.features_), []
        for prior, mean, var in zip(self.class_prior_, self.theta_, self.sigma_, strict=True):
            constant = np.log(prior) - 0.5 * np.log(2 * np.pi * var).sum()
            spread = F.aggregate(F.zip_with(F.zip_with(x, literal(mean), lambda a, m: (a - m) * (a - m)), literal(var), lambda s, v: s / v), F.lit(0.0), lambda s, v: s + v)
            out.append(F.lit(float(constant)) - 0.5 * spread)
        return F.array(*out)

    def predict(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("__joint", self._joint())
        best = F.array_position("__joint", F.array_max("__joint")).cast("int")
        return rows.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes_)), best)).drop("__joint")

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("__joint", self._joint()).withColumn("__total", logsumexp(F.col("__joint")))
        return rows.withColumn("log_probability", F.expr("transform(__joint, j -> j - __total)")).drop("__joint", "__total")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        rows = self.predict_log_proba(df)
        return rows.withColumn("probability", F.transform("log_probability", lambda p: F.exp(p))).drop("log_probability")

    def score(self, df: DataFrame, label: str) -> float:
        return metrics.accuracy_score(self.predict(df), label, "prediction")
