"""Small NumPy learners with ``partial_fit``, for incremental training, voting and search.

Anything with the same methods works in their place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quillon.operators.base import Estimator


#: Mini-batches whose rows ``SGDClassifier.fit`` puts in order at once.
FIT_BATCHES = 256


class _Learner(Estimator):
    def _begin(self, x: np.ndarray, outputs: int) -> None:
        if not hasattr(self, "coef_"):
            rng = np.random.default_rng(self.random_state)
            self.coef_ = rng.normal(0, 1e-3, (outputs, x.shape[1]))
            self.intercept_, self.t_ = np.zeros(outputs), 0


class SGDClassifier(_Learner):
    """Softmax regression by averaged mini-batch gradient steps."""

    _estimator_type = "classifier"

    def __init__(self, alpha: float = 1e-4, eta0: float = 0.5, power_t: float = 0.25, batch: int = 64, max_iter: int = 5, random_state: int = 0):
        self.alpha, self.eta0, self.power_t, self.batch, self.max_iter, self.random_state = alpha, eta0, power_t, batch, max_iter, random_state

    def partial_fit(self, x: np.ndarray, y: np.ndarray, classes: Sequence | None = None) -> SGDClassifier:
        if not hasattr(self, "classes_"):
            if classes is None:
                raise ValueError("classes must be passed on the first call to partial_fit.")
            self.classes_ = np.array(sorted(classes))
        self._begin(x, len(self.classes_))
        target = (y[:, None] == self.classes_).astype(float)
        for at in range(0, len(x), self.batch):
            xs, ts = x[at : at + self.batch], target[at : at + self.batch]
            gap = (self._softmax(xs) - ts) / len(xs)
            self.t_ += 1
            rate = self.eta0 / self.t_**self.power_t
            self.coef_ -= rate * (gap.T @ xs + self.alpha * self.coef_)
            self.intercept_ -= rate * gap.sum(0)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> SGDClassifier:
        for name in ("coef_", "classes_"):
            vars(self).pop(name, None)
        rng, classes = np.random.default_rng(self.random_state), np.unique(y)
        for _ in range(self.max_iter):
            order = rng.permutation(len(x))
            for at in range(0, max(1, len(x)), FIT_BATCHES * self.batch):  # whole mini-batches: the same steps without a copy of all rows
                part = order[at : at + FIT_BATCHES * self.batch]
                self.partial_fit(x[part], y[part], classes=classes)
        return self

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.coef_.T + self.intercept_
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes_[self._softmax(x).argmax(1)]

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        return float((self.predict(x) == y).mean())


class RidgeRegressor(_Learner):
    """Exact ridge regression; ``partial_fit`` adds to the normal equations."""

    _estimator_type = "regressor"
    #: ``partial_fit`` of the parts comes to what ``fit`` makes of the whole.
    additive = True

    def __init__(self, alpha: float = 1.0, random_state: int = 0):
        self.alpha, self.random_state = alpha, random_state

    def partial_fit(self, x: np.ndarray, y: np.ndarray) -> RidgeRegressor:
        x1 = np.column_stack((x, np.ones(len(x))))
        if not hasattr(self, "gram_"):
            self.gram_, self.moment_ = np.zeros((x1.shape[1],) * 2), np.zeros(x1.shape[1])
        self.gram_ += x1.T @ x1
        self.moment_ += x1.T @ y
        ridge = self.alpha * np.eye(len(self.gram_))
        ridge[-1, -1] = 1e-12
        beta = np.linalg.solve(self.gram_ + ridge, self.moment_)
        self.coef_, self.intercept_ = beta[:-1], beta[-1]
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> RidgeRegressor:
        for name in ("gram_", "moment_"):
            vars(self).pop(name, None)
        return self.partial_fit(x, y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef_ + self.intercept_

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        spread = ((y - y.mean()) ** 2).sum()
        rest = ((y - self.predict(x)) ** 2).sum()
        return 1.0 if rest == 0 else 0.0 if spread == 0 else float(1 - rest / spread)


class ConstantFunction(Estimator):
    """Scores its parameter, whatever it sees."""

    _estimator_type = "classifier"

    def __init__(self, value: float = 0.0):
        self.value = value

    def fit(self, x: np.ndarray, y: np.ndarray) -> ConstantFunction:
        self.coef_ = self.value
        return self

    def partial_fit(self, x: np.ndarray, y: np.ndarray, classes: Sequence | None = None) -> ConstantFunction:
        return self.fit(x, y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x))

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(self.value)


class LinearFunction(ConstantFunction):
    """Scores ``intercept + slope * calls of partial_fit``."""

    def __init__(self, intercept: float = 0.0, slope: float = 1.0):
        self.intercept, self.slope = intercept, slope

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearFunction:
        self.calls_ = getattr(self, "calls_", 0) + 1
        return self

    def score(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(self.intercept + self.slope * getattr(self, "calls_", 0))
