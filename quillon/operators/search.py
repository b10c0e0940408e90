"""Hyper-parameter search: grid, randomized, and adaptive searches over ``partial_fit``.

Grid and randomized searches take estimators that fit frames; candidates and
folds run from a pool of driver threads, each as Spark jobs over the shared,
cached folds.  Adaptive searches take learners of NumPy arrays: a round trains
all surviving models in one job, a group for each model that receives the blocks
it needs, and scores them in one pass over the test rows.
"""

from __future__ import annotations

import math
import pickle
import time
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.metrics import check_scoring
from quillon.operators.base import CALL_CELLS, Estimator, Features, clone, matrix, pieces, vector
from quillon.operators.encoders import Pipeline
from quillon.operators.ensemble import ParallelPostFit, block_of, copy_learned
from quillon.operators.splits import check_cv, uniform


class ParameterGrid:
    """All combinations, names sorted, the last name varying fastest."""

    def __init__(self, grid: Mapping[str, Sequence] | Sequence[Mapping[str, Sequence]]):
        self.grids = [grid] if isinstance(grid, Mapping) else list(grid)

    def __iter__(self) -> Iterator[dict]:
        for grid in self.grids:
            names = sorted(grid)
            for values in product(*[grid[n] for n in names]):
                yield dict(zip(names, values, strict=True))

    def __len__(self) -> int:
        return sum(math.prod(len(v) for v in g.values()) for g in self.grids)


class ParameterSampler:
    """``n_iter`` draws; lists are drawn from without repeats of a whole combination, ``rvs`` objects sampled."""

    def __init__(self, distributions: Mapping[str, object], n_iter: int, random_state: int = 0):
        self.distributions, self.n_iter, self.random_state = distributions, n_iter, random_state

    def __iter__(self) -> Iterator[dict]:
        rng = np.random.default_rng(self.random_state)
        lists = all(not hasattr(v, "rvs") for v in self.distributions.values())
        if lists:
            grid = list(ParameterGrid({k: list(v) for k, v in self.distributions.items()}))
            for k in rng.permutation(len(grid))[: self.n_iter].tolist():
                yield grid[k]
            return
        for _ in range(self.n_iter):
            yield {k: v.rvs(random_state=int(rng.integers(2**31))) if hasattr(v, "rvs") else v[int(rng.integers(len(v)))] for k, v in sorted(self.distributions.items())}


def competition_rank(scores: Sequence[float]) -> np.ndarray:
    """1 for the highest; equal scores share the best rank, NaN comes last."""
    scores = np.array(scores, dtype=float)
    clean = np.where(np.isnan(scores), -np.inf, scores)
    return np.array([1 + int((clean > s).sum()) for s in clean], dtype=int)


class _Search(Estimator):
    def _delegate(self) -> object:
        self.check_fitted("best_estimator_")
        return self.best_estimator_

    def predict(self, df: DataFrame) -> DataFrame:
        return self._delegate().predict(df)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._delegate().predict_proba(df)

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        return self._delegate().predict_log_proba(df)

    def decision_function(self, df: DataFrame) -> DataFrame:
        return self._delegate().decision_function(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._delegate().transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._delegate().inverse_transform(df)

    def score(self, df: DataFrame, label: str) -> float:
        return self.scorer_(self._delegate(), df, label)

    def results_df(self, spark: object) -> DataFrame:
        """The results as a frame, one row for each candidate."""
        table = pd.DataFrame({k: [str(v) if isinstance(v, dict) else v for v in vs] for k, vs in self.cv_results_.items()})
        return spark.createDataFrame(table.astype({c: str for c in table if table[c].dtype == object}))


class _CVSearch(_Search):
    def _candidates(self) -> list[dict]:
        raise NotImplementedError

    def fit(self, df: DataFrame, features: Features, label: str) -> _CVSearch:
        multi = isinstance(self.scoring, (dict, list, tuple))
        if multi:
            named = self.scoring if isinstance(self.scoring, dict) else {s: s for s in self.scoring}
            scorers = {k: check_scoring(self.estimator, s) for k, s in named.items()}
            if self.refit and self.refit not in scorers:
                raise ValueError("For multi-metric scoring, the parameter refit must be set to a scorer key")
        else:
            scorers = {"score": check_scoring(self.estimator, self.scoring)}
        if not (self.error_score == "raise" or isinstance(self.error_score, (int, float))):
            raise ValueError("error_score must be the string 'raise' or a numeric value.")
        candidates = self._candidates()
        classifier = getattr(self.estimator, "_estimator_type", "") == "classifier"
        splits = [(a.persist(), b.persist()) for a, b in check_cv(self.cv, self.key, label, classifier).split(df)]
        weights = [b.count() for _, b in splits]

        def one(task: tuple[int, int]) -> dict:
            c, s = task
            train, test = splits[s]
            out = {"fit": 0.0, "scored": 0.0}
            try:
                start = time.monotonic()
                model = clone(self.estimator).set_params(**candidates[c])
                if isinstance(model, Pipeline) and len(model.steps) > 1:
                    # Candidates that differ in the last step only share the fit of those before it.
                    key = (s, model.prefix())
                    with guard:
                        lock = locks.setdefault(key, Lock())
                    with lock:
                        if key not in prefixes:
                            prefixes[key] = model.fit_prefix(train)
                    fitted, rows = prefixes[key], train
                    for _, step in fitted:
                        rows = step.transform(rows)
                    model.fit_last(fitted, rows, features, label)
                else:
                    model.fit(train, features, label)
                out["fit"], start = time.monotonic() - start, time.monotonic()
                for name, scorer in scorers.items():
                    out[f"test_{name}"] = scorer(model, test, label)
                    if self.return_train_score:
                        out[f"train_{name}"] = scorer(model, train, label)
                out["scored"] = time.monotonic() - start
            except Exception:
                if self.error_score == "raise":
                    raise
                for name in scorers:
                    out[f"test_{name}"] = out[f"train_{name}"] = float(self.error_score)
            return out

        prefixes: dict[tuple, list] = {}
        locks: dict[tuple, Lock] = {}
        guard = Lock()
        tasks = list(product(range(len(candidates)), range(len(splits))))
        with ThreadPoolExecutor(self.n_jobs if self.n_jobs > 0 else 8) as pool:
            made = dict(zip(tasks, pool.map(one, tasks), strict=True))
        for a, b in splits:
            a.unpersist()
            b.unpersist()
        self.prefix_fits_ = len(prefixes)
        self.n_splits_, self.multimetric_, self.scorer_ = len(splits), multi, scorers[self.refit] if multi and self.refit else next(iter(scorers.values()))
        self.cv_results_ = self._results(candidates, made, scorers, weights)
        main = self.refit if multi else "score"
        if self.refit:
            self.best_index_ = int(np.flatnonzero(self.cv_results_[f"rank_test_{main}"] == 1)[0])
            self.best_params_ = candidates[self.best_index_]
            self.best_score_ = float(self.cv_results_[f"mean_test_{main}"][self.best_index_])
            self.best_estimator_ = clone(self.estimator).set_params(**self.best_params_).fit(df, features, label)
        return self

    def _results(self, candidates: list[dict], made: dict, scorers: dict, weights: list[int]) -> dict:
        n, splits = len(candidates), len(weights)
        out: dict[str, object] = {"params": candidates}
        for name in sorted({k for c in candidates for k in c}):
            out[f"param_{name}"] = np.ma.array([c.get(name) for c in candidates], mask=[name not in c for c in candidates], dtype=object)
        grid = lambda key: np.array([[made[c, s].get(key, np.nan) for s in range(splits)] for c in range(n)])
        for part, key in (("fit", "fit"), ("score", "scored")):
            times = grid(key)
            out[f"mean_{part}_time"], out[f"std_{part}_time"] = times.mean(1), times.std(1)
        for name in scorers:
            for side in ("test", *(("train",) if self.return_train_score else ())):
                scores = grid(f"{side}_{name}")
                weight = np.array(weights, dtype=float) if self.iid and side == "test" else np.ones(splits)
                mean = (scores * weight).sum(1) / weight.sum()
                for s in range(splits):
                    out[f"split{s}_{side}_{name}"] = scores[:, s]
                out[f"mean_{side}_{name}"] = mean
                out[f"std_{side}_{name}"] = np.sqrt(((scores - mean[:, None]) ** 2 * weight).sum(1) / weight.sum())
                if side == "test":
                    out[f"rank_test_{name}"] = competition_rank(mean)
        return out


class GridSearchCV(_CVSearch):
    def __init__(self, estimator: object, param_grid: Mapping[str, Sequence], scoring: object = None, iid: bool = True, refit: bool | str = True, cv: object = None, error_score: object = "raise", return_train_score: bool = False, n_jobs: int = -1, key: str = "id"):
        self.estimator, self.param_grid, self.scoring, self.iid, self.refit, self.cv = estimator, param_grid, scoring, iid, refit, cv
        self.error_score, self.return_train_score, self.n_jobs, self.key = error_score, return_train_score, n_jobs, key

    def _candidates(self) -> list[dict]:
        return list(ParameterGrid(self.param_grid))


class RandomizedSearchCV(_CVSearch):
    def __init__(self, estimator: object, param_distributions: Mapping[str, object], n_iter: int = 10, random_state: int = 0, scoring: object = None, iid: bool = True, refit: bool | str = True, cv: object = None, error_score: object = "raise", return_train_score: bool = False, n_jobs: int = -1, key: str = "id"):
        self.estimator, self.param_distributions, self.n_iter, self.random_state = estimator, param_distributions, n_iter, random_state
        self.scoring, self.iid, self.refit, self.cv, self.error_score = scoring, iid, refit, cv, error_score
        self.return_train_score, self.n_jobs, self.key = return_train_score, n_jobs, key

    def _candidates(self) -> list[dict]:
        return list(ParameterSampler(self.param_distributions, self.n_iter, self.random_state))


# Adaptive searches

Info = dict[int, list[dict]]


class Rounds:
    """Training and scoring of many learners over the blocks of a frame."""

    cells = CALL_CELLS

    def __init__(self, df: DataFrame, features: Features, label: str, key: str, n_blocks: int, test_size: float, seed: int, fit_kw: dict):
        rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").alias("y"), F.col(f"`{key}`").alias("k"), block_of(key, n_blocks).alias("block"))
        held = uniform("k", seed) < test_size
        self.train, self.test = rows.where(~held).persist(), rows.where(held).select("x", "y").persist()
        self.features, self.n_blocks, self.fit_kw = features, n_blocks, fit_kw
        self.rng = np.random.default_rng(seed)
        self.order: list[int] = []
        self.lock = Lock()

    def block(self, call: int) -> int:
        """Block of a model's n-th call: independent shuffles of all blocks, one behind the other."""
        with self.lock:  # brackets share the rounds
            while len(self.order) <= call:
                self.order += self.rng.permutation(self.n_blocks).tolist()
            return self.order[call]

    def advance(self, models: dict[int, object], calls: dict[int, tuple[int, int]]) -> dict[int, object]:
        """Models after ``partial_fit`` number start to stop - 1.

        The rows of a model lie in one task, sorted, and stream through it: it
        holds one piece of a block, and a larger block is several calls.
        """
        spark, fit_kw, cells = self.train.sparkSession, self.fit_kw, self.cells
        steps = [(m, c, self.block(c)) for m, (start, stop) in calls.items() for c in range(start, stop)]
        if not steps:
            return models
        state = spark.sparkContext.broadcast({m: pickle.dumps(models[m]) for m in calls})
        plan = spark.createDataFrame(steps, "model int, call int, block int")

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = lambda m, model: pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["model", "state"])
            last, model = None, None
            for (m, _), x, y in pieces(batches, ("model", "call"), cells):
                if m != last:
                    if last is not None:
                        yield done(last, model)
                    last, model = m, pickle.loads(state.value[m])
                model.partial_fit(x, y, **fit_kw)
            if last is not None:
                yield done(last, model)

        joined = self.train.join(F.broadcast(plan), "block").repartition("model")  # as many rows as calls
        made = joined.sortWithinPartitions("model", "call", F.col("k").asc_nulls_last()).select("model", "call", "x", "y").mapInArrow(train, "model int, state binary").collect()
        return models | {r["model"]: pickle.loads(bytes(r["state"])) for r in made}

    def scores(self, models: dict[int, object], scoring: object) -> dict[int, float]:
        """Scores over all test rows, weighted by the rows of each batch."""
        state = self.test.sparkSession.sparkContext.broadcast(pickle.dumps(models))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pickle.loads(state.value)
            for batch in batches:
                if len(batch):
                    x, y = matrix(batch["x"]), batch["y"].to_numpy()
                    made = [(scoring(m, x, y) if callable(scoring) else m.score(x, y)) * len(y) for m in own.values()]
                    yield pd.DataFrame({"model": list(own), "total": made, "n": len(y)})

        found = self.test.mapInPandas(run, "model int, total double, n long").groupBy("model").agg((F.sum("total") / F.sum("n")).alias("score")).collect()
        return {r["model"]: r["score"] for r in found}

    def close(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


class BaseIncrementalSearchCV(_Search):
    """Rounds of training, scoring and a policy ``_additional_calls(info)`` that says how many more calls each model gets."""

    def _check(self) -> None:
        if self.max_iter is not None and self.max_iter < 1:
            raise ValueError(f"max_iter must be at least 1, not {self.max_iter}")
        if self.patience and (isinstance(self.patience, bool) and not isinstance(self, HyperbandSearchCV) or isinstance(self.patience, int) and not isinstance(self.patience, bool) and self.patience < 2):
            raise ValueError("patience must be an integer of at least 2")

    def _parameters(self) -> list[dict]:
        if self.n_initial_parameters == "grid":
            return list(ParameterGrid(self.parameters))
        return list(ParameterSampler(self.parameters, self.n_initial_parameters, self.random_state))

    def _first_calls(self) -> int:
        return 1

    def _additional_calls(self, info: Info) -> dict[int, int]:
        raise NotImplementedError

    def _stopped(self, info: Info, instructions: dict[int, int]) -> dict[int, int]:
        """No more calls for models at ``max_iter`` or on a plateau."""
        out = {}
        for m, more in instructions.items():
            calls = info[m][-1]["partial_fit_calls"]
            if self.max_iter is not None:
                more = min(more, self.max_iter - calls)
            if self.patience and more > 0:
                window = [h["score"] for h in info[m] if h["partial_fit_calls"] >= calls - self.patience]
                full = info[m][0]["partial_fit_calls"] <= calls - self.patience
                if full and len(window) > 1 and max(window[1:]) - window[0] <= self.tol:
                    more = 0
            out[m] = max(0, more)
        return out

    def fit(self, df: DataFrame, features: Features, label: str, **fit_kw: object) -> BaseIncrementalSearchCV:
        self._check()
        test_size = self.test_size if self.test_size is not None else min(0.2, 1 / self.n_blocks)
        rounds = Rounds(df, features, label, self.key, self.n_blocks, test_size, self.random_state, fit_kw)
        try:
            self._search(rounds)
        finally:
            rounds.close()
        self._finish(features)
        return self

    def _search(self, rounds: Rounds) -> None:
        params = dict(enumerate(self._parameters()))
        models = {m: clone(self.estimator).set_params(**p) for m, p in params.items()}
        calls, info, history = dict.fromkeys(models, 0), defaultdict(list), []
        wanted = dict.fromkeys(models, self._first_calls())
        start = time.monotonic()
        while wanted:
            began = time.monotonic()
            models = rounds.advance(models, {m: (calls[m], calls[m] + k) for m, k in wanted.items() if k})
            took = (time.monotonic() - began) / max(1, len(wanted))
            began = time.monotonic()
            scores = rounds.scores({m: models[m] for m in wanted}, self.scoring if callable(self.scoring) else None)
            scored = (time.monotonic() - began) / max(1, len(wanted))
            for m, k in wanted.items():
                calls[m] += k
                meta = {"model_id": m, "params": params[m], "partial_fit_calls": calls[m], "partial_fit_time": took, "score": scores[m], "score_time": scored, "elapsed_wall_time": time.monotonic() - start}
                info[m].append(meta)
                history.append(meta)
            instructions = self._stopped(info, self._additional_calls({m: info[m] for m in wanted}))
            wanted = {m: k for m, k in instructions.items() if k > 0}
        self.history_, self.model_history_, self._models = history, dict(info), models

    def _finish(self, features: Features) -> None:
        final = {m: h[-1]["score"] for m, h in self.model_history_.items()}
        best = max(final, key=lambda m: final[m])
        ids = list(self.model_history_)
        last = [self.model_history_[m][-1] for m in ids]
        times = {k: [[h[k] for h in self.model_history_[m]] for m in ids] for k in ("partial_fit_time", "score_time")}
        self.cv_results_ = {
            "model_id": ids,
            "params": [h["params"] for h in last],
            "test_score": np.array([h["score"] for h in last]),
            "rank_test_score": competition_rank([h["score"] for h in last]),
            "partial_fit_calls": np.array([h["partial_fit_calls"] for h in last]),
        }
        for name, values in times.items():
            self.cv_results_[f"mean_{name}"], self.cv_results_[f"std_{name}"] = np.array([np.mean(v) for v in values]), np.array([np.std(v) for v in values])
        for name in sorted({k for h in last for k in h["params"]}):
            self.cv_results_[f"param_{name}"] = [h["params"].get(name) for h in last]
        self.best_index_, self.best_score_, self.best_params_ = ids.index(best), final[best], self.model_history_[best][-1]["params"]
        self.n_models_ = len(ids)
        wrapper = ParallelPostFit(self._models[best])
        wrapper.estimator_, wrapper.features_ = self._models[best], features
        copy_learned(self._models[best], wrapper)
        self.best_estimator_ = wrapper
        self.scorer_ = lambda est, df, label: est.score(df, label)


class IncrementalSearchCV(BaseIncrementalSearchCV):
    """All models go on, ``fits_per_score`` calls at a time, until ``max_iter`` or a plateau."""

    def __init__(self, estimator: object, parameters: Mapping, n_initial_parameters: int | str = 10, test_size: float | None = None, patience: int | bool = False, tol: float = 1e-3, fits_per_score: int = 1, max_iter: int | None = 100, random_state: int = 0, scoring: object = None, key: str = "id", n_blocks: int = 8):
        self.estimator, self.parameters, self.n_initial_parameters, self.test_size, self.patience, self.tol = estimator, parameters, n_initial_parameters, test_size, patience, tol
        self.fits_per_score, self.max_iter, self.random_state, self.scoring, self.key, self.n_blocks = fits_per_score, max_iter, random_state, scoring, key, n_blocks

    def _first_calls(self) -> int:
        return 1

    def _additional_calls(self, info: Info) -> dict[int, int]:
        return {m: min(self.fits_per_score, (self.max_iter or 10**9) - h[-1]["partial_fit_calls"]) for m, h in info.items()}


class InverseDecaySearchCV(IncrementalSearchCV):
    """After round t the best n / (1 + t)^decay_rate models go on."""

    def __init__(self, estimator: object, parameters: Mapping, n_initial_parameters: int | str = 10, test_size: float | None = None, patience: int | bool = False, tol: float = 1e-3, fits_per_score: int = 1, max_iter: int | None = 100, random_state: int = 0, scoring: object = None, decay_rate: float = 1.0, key: str = "id", n_blocks: int = 8):
        super().__init__(estimator, parameters, n_initial_parameters, test_size, patience, tol, fits_per_score, max_iter, random_state, scoring, key, n_blocks)
        self.decay_rate = decay_rate

    def _search(self, rounds: Rounds) -> None:
        self._step = 0
        super()._search(rounds)

    def _additional_calls(self, info: Info) -> dict[int, int]:
        if self._step == 0:
            self._initial = len(info)
        self._step += 1
        keep = max(1, int(self._initial / (1 + self._step) ** self.decay_rate))
        best = sorted(info, key=lambda m: info[m][-1]["score"], reverse=True)[:keep]
        if len(best) == 1 and self.max_iter is not None:
            return {best[0]: self.max_iter - info[best[0]][-1]["partial_fit_calls"]}
        return super()._additional_calls({m: info[m] for m in best})


def halving_schedule(n: int, r: float, aggressiveness: float, limit: int | None = None) -> list[tuple[int, int]]:
    """(models, calls that each of them has had) of every step of successive halving."""
    out = []
    for step in range(10**6):
        models, calls = math.floor(n * aggressiveness**-step + 1e-9), round(r * aggressiveness**step)
        if models < 1:
            break
        out.append((models, min(calls, limit) if limit else calls))
        if models == 1 or limit and calls >= limit:
            break
    return out


class SuccessiveHalvingSearchCV(BaseIncrementalSearchCV):
    """Step s keeps n * eta^-s models and trains them to r * eta^s calls."""

    def __init__(self, estimator: object, parameters: Mapping, n_initial_parameters: int | str = 10, n_initial_iter: int | None = None, max_iter: int | None = None, aggressiveness: float = 3, test_size: float | None = None, patience: int | bool = False, tol: float = 1e-3, random_state: int = 0, scoring: object = None, key: str = "id", n_blocks: int = 8):
        self.estimator, self.parameters, self.n_initial_parameters, self.n_initial_iter, self.max_iter = estimator, parameters, n_initial_parameters, n_initial_iter, max_iter
        self.aggressiveness, self.test_size, self.patience, self.tol = aggressiveness, test_size, patience, tol
        self.random_state, self.scoring, self.key, self.n_blocks = random_state, scoring, key, n_blocks

    def _check(self) -> None:
        super()._check()
        if self.n_initial_iter is None:
            raise ValueError("n_initial_iter must be specified")

    def _first_calls(self) -> int:
        return self.n_initial_iter

    def _search(self, rounds: Rounds) -> None:
        self._step = 0
        super()._search(rounds)
        self.metadata_ = {"n_models": len(self.model_history_), "partial_fit_calls": sum(h[-1]["partial_fit_calls"] for h in self.model_history_.values())}

    def _additional_calls(self, info: Info) -> dict[int, int]:
        if self._step == 0:
            self._initial = len(info)
        self._step += 1
        schedule = halving_schedule(self._initial, self.n_initial_iter, self.aggressiveness, self.max_iter)
        if self._step >= len(schedule):
            return {}
        keep, calls = schedule[self._step]
        best = sorted(info, key=lambda m: info[m][-1]["score"], reverse=True)[:keep]
        return {m: calls - info[m][-1]["partial_fit_calls"] for m in best}

    @property
    def metadata(self) -> dict:
        return halving_totals(self.n_initial_parameters if self.n_initial_parameters != "grid" else len(ParameterGrid(self.parameters)), self.n_initial_iter, self.aggressiveness, self.max_iter)


def halving_totals(n: int, r: float, aggressiveness: float, limit: int | None = None) -> dict:
    schedule = halving_schedule(n, r, aggressiveness, limit)
    done, calls = 0, 0
    for models, upto in schedule:
        calls += models * (upto - done)
        done = upto
    return {"n_models": n, "partial_fit_calls": calls}


def hyperband_brackets(max_iter: int, aggressiveness: float = 3) -> list[tuple[int, int, int]]:
    """(bracket, models, calls at the start) from the most to the least aggressive bracket."""
    s_max = math.floor(math.log(max_iter) / math.log(aggressiveness) + 1e-9)
    budget = (s_max + 1) * max_iter
    return [(s, math.ceil(budget / max_iter * aggressiveness**s / (s + 1) - 1e-9), math.floor(max_iter * aggressiveness**-s + 1e-9)) for s in range(s_max, -1, -1)]


class HyperbandSearchCV(BaseIncrementalSearchCV):
    """Successive halving in brackets that trade the number of models for training."""

    n_initial_parameters = 0

    def __init__(self, estimator: object, parameters: Mapping, max_iter: int = 81, aggressiveness: float = 3, patience: int | bool = False, tol: float = 1e-3, test_size: float | None = None, random_state: int = 0, scoring: object = None, key: str = "id", n_blocks: int = 8):
        self.estimator, self.parameters, self.max_iter, self.aggressiveness, self.patience = estimator, parameters, max_iter, aggressiveness, patience
        self.tol, self.test_size, self.random_state, self.scoring, self.key, self.n_blocks = tol, test_size, random_state, scoring, key, n_blocks

    def _patience(self) -> int | bool:
        """True takes what keeps about eta plateaus apart."""
        if self.patience is True:
            return max(int(self.max_iter // self.aggressiveness), 1)
        return self.patience

    def _search(self, rounds: Rounds) -> None:
        brackets = hyperband_brackets(self.max_iter, self.aggressiveness)

        def one(bracket: tuple[int, int, int]) -> SuccessiveHalvingSearchCV:
            s, n, r = bracket
            search = SuccessiveHalvingSearchCV(self.estimator, self.parameters, n, r, self.max_iter, self.aggressiveness, random_state=self.random_state + s, tol=self.tol, scoring=self.scoring)
            search.patience = max(self._patience(), 2) if self.patience else False
            search._search(rounds)
            return search

        with ThreadPoolExecutor(len(brackets)) as pool:
            found = dict(zip([b[0] for b in brackets], pool.map(one, brackets), strict=True))
        self._SHAs_ = found
        self.history_, self.model_history_, self._models = [], {}, {}
        for s, search in found.items():
            for m, model in search._models.items():
                name = f"bracket={s}-{m}"
                self._models[name] = model
                self.model_history_[name] = [h | {"model_id": name, "bracket": s} for h in search.model_history_[m]]
                self.history_ += self.model_history_[name]
        self.history_.sort(key=lambda h: h["elapsed_wall_time"])
        self.metadata_ = {"n_models": len(self._models), "partial_fit_calls": sum(h[-1]["partial_fit_calls"] for h in self.model_history_.values()), "brackets": [{"bracket": s} | search.metadata_ for s, search in sorted(found.items(), reverse=True)]}

    @property
    def metadata(self) -> dict:
        parts = [{"bracket": s} | halving_totals(n, r, self.aggressiveness, self.max_iter) for s, n, r in hyperband_brackets(self.max_iter, self.aggressiveness)]
        return {"n_models": sum(p["n_models"] for p in parts), "partial_fit_calls": sum(p["partial_fit_calls"] for p in parts), "brackets": parts}


