"""Meta-estimators around learners of NumPy arrays: parallel inference, incremental training, voting.

Blocks are logical: a hash of ``key`` modulo ``n_blocks``.  A block is what one
task or one ``partial_fit`` call holds in memory; choose their number so that
it fits.  Models travel as pickled bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions.metrics import accuracy_score, get_scorer, r2_score
from quillon.operators.base import CALL_CELLS, Estimator, Features, arrow_values, clone, matrix, pieces, vector


#: Rows that one call of ``partial_fit`` gets at most.
CALL_ROWS = 100_000


def block_of(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(n_blocks)).cast("int")


def _kind(values: np.ndarray) -> str:
    values = np.asarray(values)
    base = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}.get(values.dtype.kind, "string")
    return f"array<{base}>" if values.ndim == 2 else base


def apply_model(df: DataFrame, features: Features, call: Callable[[np.ndarray], np.ndarray], output: str, example: np.ndarray | None = None, kind: str | None = None) -> DataFrame:
    """``df`` with what ``call`` makes of batches of the feature matrix; its type is tried on ``example``."""
    if kind is None:
        kind = _kind(call(example))
    rows = df.withColumn("__x", vector(features))
    kept = [c for c in df.columns if c != output]

    target = to_arrow_type(T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = np.asarray(call(np.array(arrow_values(batch.column(len(kept))))))
                if made.ndim == 2 and made.shape[1]:
                    values = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1])
                else:
                    values = pa.array(list(made) if made.ndim == 2 else made, from_pandas=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], values.cast(target)], [*kept, output])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != output], f"`{output}` {kind}"])
    return rows.select(*[f"`{c}`" for c in kept], "__x").mapInArrow(run, schema)


def copy_learned(source: object, target: object) -> None:
    """Copies attributes that end with an underscore."""
    for name, value in vars(source).items():
        if name.endswith("_") and not name.startswith("_"):
            setattr(target, name, value)


class ParallelPostFit(Estimator):
    """Fits a learner on data in memory, then predicts, transforms and scores frames in Arrow batches."""

    def __init__(self, estimator: object, scoring: str | Callable | None = None, predict_meta: np.ndarray | None = None, predict_proba_meta: np.ndarray | None = None, transform_meta: np.ndarray | None = None):
        self.estimator, self.scoring = estimator, scoring
        self.predict_meta, self.predict_proba_meta, self.transform_meta = predict_meta, predict_proba_meta, transform_meta

    def fit(self, x: np.ndarray, y: np.ndarray | None = None, features: Features | None = None) -> ParallelPostFit:
        model = clone(self.estimator) if hasattr(self.estimator, "get_params") else self.estimator
        self.estimator_ = model.fit(x) if y is None else model.fit(x, y)
        self.features_ = features
        copy_learned(self.estimator_, self)
        return self

    def partial_fit(self, x: np.ndarray, y: np.ndarray, features: Features | None = None, **kw: object) -> ParallelPostFit:
        if not hasattr(self, "estimator_"):
            self.estimator_ = clone(self.estimator)
        self.estimator_.partial_fit(x, y, **kw)
        self.features_ = features if features is not None else getattr(self, "features_", None)
        copy_learned(self.estimator_, self)
        return self

    def _call(self, df: DataFrame, method: str, output: str, meta: np.ndarray | None, features: Features | None) -> DataFrame:
        model = getattr(self, "estimator_", self.estimator)
        if not hasattr(model, method):
            raise AttributeError(f"The wrapped estimator {model!r} does not have a {method!r} method.")
        features = features if features is not None else self.features_
        state = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # one model
        size = df.select(F.size(vector(features))).first()
        example = np.zeros((1, size[0] if size else 1))
        kind = _kind(meta) if meta is not None else _kind(getattr(model, method)(example))
        return apply_model(df, features, lambda x: getattr(pickle.loads(state.value), method)(x), output, kind=kind)

    def predict(self, df: DataFrame, features: Features | None = None) -> DataFrame:
        return self._call(df, "predict", "prediction", self.predict_meta, features)

    def predict_proba(self, df: DataFrame, features: Features | None = None) -> DataFrame:
        return self._call(df, "predict_proba", "probability", self.predict_proba_meta, features)

    def predict_log_proba(self, df: DataFrame, features: Features | None = None) -> DataFrame:
        out = self.predict_proba(df, features)
        return out.withColumn("log_probability", F.transform("probability", lambda p: F.log(p))).drop("probability")

    def transform(self, df: DataFrame, features: Features | None = None) -> DataFrame:
        return self._call(df, "transform", "transformed", self.transform_meta, features)

    def score(self, df: DataFrame, label: str, features: Features | None = None) -> float:
        if features is not None:
            self.features_ = features
        if self.scoring is not None:
            return get_scorer(self.scoring)(self, df, label)
        kind = getattr(self.estimator, "_estimator_type", "classifier")
        metric = r2_score if kind == "regressor" else accuracy_score
        return metric(self.predict(df), label, "prediction")


def sequential_fit(model: object, df: DataFrame, features: Features, label: str, key: str, n_blocks: int, order: Sequence[int], **kw: object) -> object:
    """``partial_fit`` over blocks in turn; a block's rows come to the driver alone and are forgotten.

    Whatever the table's size, a call gets ``CALL_ROWS`` rows at most: larger
    blocks are streamed to several calls, in the order of ``key``.
    """
    if not hasattr(model, "partial_fit"):
        raise ValueError(f"{type(model).__name__} can't be trained in parts: it has no partial_fit")
    rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").alias("y"), block_of(key, n_blocks).alias("b"), F.col(f"`{key}`").alias("k")).persist()
    try:
        sizes = {r["b"]: r["count"] for r in rows.groupBy("b").count().collect()}  # n_blocks rows
        for block in order:
            part = rows.where(F.col("b") == block).orderBy("k").select("x", "y")
            if 0 < sizes.get(block, 0) <= CALL_ROWS:
                own = part.toPandas()
                model.partial_fit(matrix(own["x"]), own["y"].to_numpy(), **kw)
                continue
            stream = part.toLocalIterator()
            while held := list(islice(stream, CALL_ROWS)):
                model.partial_fit(np.array([r["x"] for r in held], dtype=float), np.array([r["y"] for r in held]), **kw)
    finally:
        rows.unpersist()
    return model


class Incremental(ParallelPostFit):
    """Trains a learner block after block, in an order shuffled by the seed."""

    def __init__(self, estimator: object, key: str = "id", n_blocks: int = 8, scoring: str | Callable | None = None, shuffle_blocks: bool = True, random_state: int = 0, predict_meta: np.ndarray | None = None, predict_proba_meta: np.ndarray | None = None, transform_meta: np.ndarray | None = None):
        super().__init__(estimator, scoring, predict_meta, predict_proba_meta, transform_meta)
        self.key, self.n_blocks, self.shuffle_blocks, self.random_state = key, n_blocks, shuffle_blocks, random_state

    def _train(self, df: DataFrame, features: Features, label: str, **kw: object) -> Incremental:
        order = np.arange(self.n_blocks)
        if self.shuffle_blocks:
            order = np.random.default_rng(self.random_state).permutation(order)
        sequential_fit(self.estimator_, df, features, label, self.key, self.n_blocks, order.tolist(), **kw)
        self.features_ = features
        copy_learned(self.estimator_, self)
        return self

    def fit(self, df: DataFrame, features: Features, label: str, **kw: object) -> Incremental:
        self.estimator_ = clone(self.estimator)
        return self._train(df, features, label, **kw)

    def partial_fit(self, df: DataFrame, features: Features, label: str, **kw: object) -> Incremental:
        if not hasattr(self, "estimator_"):
            self.estimator_ = clone(self.estimator)
        return self._train(df, features, label, **kw)


class _Blockwise(Estimator):
    """One learner for each block, trained where the block's rows meet.

    A learner with ``additive`` gets a block in pieces, and the task holds one of
    them; any other is given the block whole, as one matrix.
    """

    cells = CALL_CELLS

    def fit(self, df: DataFrame, features: Features, label: str) -> _Blockwise:
        state, cells = pickle.dumps(self.estimator), self.cells

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in groupby(pieces(batches, ("block",), cells), lambda p: p[0][0]):
                model = clone(pickle.loads(state))
                if getattr(model, "additive", False):
                    for _, x, y in parts:
                        model.partial_fit(x, y)
                else:
                    x, y = map(list, zip(*[p[1:] for p in parts], strict=True))
                    x, y = (v[0] if len(v) == 1 else np.concatenate(v) for v in (x, y))
                    model = model.fit(x, y)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["block", "model"])

        rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").alias("y"), block_of(self.key, self.n_blocks).alias("block"), F.col(f"`{self.key}`").alias("k"))
        rows = rows.repartition("block").sortWithinPartitions("block", F.col("k").asc_nulls_last()).select("block", "x", "y")
        found = rows.mapInArrow(train, "block int, model binary").orderBy("block").collect()  # n_blocks models
        self.estimators_ = [pickle.loads(bytes(r["model"])) for r in found]
        self.features_ = features
        return self

    def _stacked(self, df: DataFrame, combine: Callable[[list, np.ndarray], np.ndarray], output: str, kind: str) -> DataFrame:
        self.check_fitted("estimators_")
        state = df.sparkSession.sparkContext.broadcast(pickle.dumps(self.estimators_))  # n_blocks models
        return apply_model(df, self.features_, lambda x: combine(pickle.loads(state.value), x), output, kind=kind)


class BlockwiseVotingClassifier(_Blockwise):
    """Hard voting takes the commonest label (smallest of equals), soft voting the best mean probability."""

    def __init__(self, estimator: object, voting: str = "hard", classes: Sequence[int] | None = None, key: str = "id", n_blocks: int = 4):
        self.estimator, self.voting, self.classes, self.key, self.n_blocks = estimator, voting, classes, key, n_blocks

    def fit(self, df: DataFrame, features: Features, label: str, classes: Sequence[int] | None = None) -> BlockwiseVotingClassifier:
        classes = classes if classes is not None else self.classes
        if classes is None:
            raise ValueError("Must specify the classes of the labels")
        self.classes_ = sorted(classes)
        return super().fit(df, features, label)

    def predict(self, df: DataFrame) -> DataFrame:
        classes = np.array(self.classes_)
        if self.voting == "soft":
            return self._stacked(df, lambda models, x: classes[np.mean([m.predict_proba(x) for m in models], axis=0).argmax(1)], "prediction", _kind(classes))

        def vote(models: list, x: np.ndarray) -> np.ndarray:
            votes = np.array([m.predict(x) for m in models])
            return classes[(votes[:, :, None] == classes).sum(0).argmax(1)]

        return self._stacked(df, vote, "prediction", _kind(classes))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.voting == "hard":
            raise AttributeError("predict_proba is not available when voting='hard'")
        return self._stacked(df, lambda models, x: np.mean([m.predict_proba(x) for m in models], axis=0), "probability", "array<double>")

    def score(self, df: DataFrame, label: str) -> float:
        return accuracy_score(self.predict(df), label, "prediction")


class BlockwiseVotingRegressor(_Blockwise):
    """Mean of the blocks' predictions."""

    def __init__(self, estimator: object, key: str = "id", n_blocks: int = 4):
        self.estimator, self.key, self.n_blocks = estimator, key, n_blocks

    def predict(self, df: DataFrame) -> DataFrame:
        return self._stacked(df, lambda models, x: np.mean([m.predict(x) for m in models], axis=0), "prediction", "double")

    def score(self, df: DataFrame, label: str) -> float:
        return r2_score(self.predict(df), label, "prediction")


def gradient_boosting(kind: str = "classifier", **params: object) -> object:
    """Boosted trees of ``pyspark.ml``, in place of an external gradient-boosting bridge."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    return (GBTClassifier if kind == "classifier" else GBTRegressor)(**params)


def vector_udt(df: DataFrame, features: Features, output: str = "features") -> DataFrame:
    """``df`` with the features as a ``pyspark.ml`` vector."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(output, array_to_vector(vector(features)))


