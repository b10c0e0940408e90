"""Train/test splits and cross-validation, deterministic under a seed.

Random choices hash an identifier column with the seed; partitioning never
matters.  Blocks are logical (a hash of the identifier), not physical partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.positions import fold_of, with_position
from quillon.operators.base import Estimator

Pair = tuple[DataFrame, DataFrame]


def uniform(key: str, seed: int) -> Column:
    """Uniform in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), 11).cast("double") / float(1 << 53)


def sizes(test_size: float | None, train_size: float | None) -> tuple[float, float]:
    if isinstance(test_size, int) and not isinstance(test_size, bool) or isinstance(train_size, int) and not isinstance(train_size, bool):
        raise ValueError("sizes must be fractions of the rows")
    if test_size is None:
        test_size = 0.1 if train_size is None else 1 - train_size
    if train_size is None:
        train_size = 1 - test_size
    if not (0 <= test_size <= 1 and 0 <= train_size <= 1) or test_size + train_size > 1.001 or test_size + train_size < 0.999:
        raise ValueError("The sum of train_size and test_size should be 1")
    return test_size, train_size


def train_test_split(*frames: DataFrame, key: str, test_size: float | None = None, train_size: float | None = None, random_state: int = 0, shuffle: bool | None = None, blockwise: bool = True) -> list[DataFrame]:
    """Train and test part of each frame; rows with equal keys go to the same side in all of them.

    A filter on a hash: nothing is shuffled, so sizes hold on average.
    """
    if not frames:
        raise ValueError("At least one array required as input")
    if shuffle is False or not blockwise:
        raise NotImplementedError("only blockwise shuffled splits")
    if any(not isinstance(f, DataFrame) for f in frames):
        raise TypeError("Got an object that isn't a DataFrame")
    test, _ = sizes(test_size, train_size)
    out = []
    for frame in frames:
        tested = uniform(key, random_state) < test
        out += [frame.where(~tested), frame.where(tested)]
    return out


class _Splitter(Estimator):
    def get_n_splits(self) -> int:
        return self.n_splits


class ShuffleSplit(_Splitter):
    """Random splits of exact sizes inside each of ``n_blocks`` logical blocks."""

    def __init__(self, key: str, n_splits: int = 10, test_size: float | None = 0.1, train_size: float | None = None, blockwise: bool = True, random_state: int = 0, n_blocks: int | None = None):
        self.key, self.n_splits, self.test_size, self.train_size = key, n_splits, test_size, train_size
        self.blockwise, self.random_state, self.n_blocks = blockwise, random_state, n_blocks

    def assign(self, df: DataFrame, split: int) -> DataFrame:
        """``df`` with a boolean column ``is_test`` of one split."""
        if not self.blockwise:
            raise NotImplementedError("blockwise=False")
        test, _ = sizes(self.test_size, self.train_size)
        blocks = self.n_blocks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seed = self.random_state * 1_000_003 + split
        rows = df.withColumn("__block", F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(blocks)))
        place = F.row_number().over(W.partitionBy("__block").orderBy(F.xxhash64(F.col(f"`{self.key}`"), F.lit(seed)), F.col(f"`{self.key}`")))
        held = F.floor(F.count(F.lit(1)).over(W.partitionBy("__block")) * test + 0.5)
        return rows.withColumn("is_test", place <= held).drop("__block")

    def split(self, df: DataFrame) -> Iterator[Pair]:
        for k in range(self.n_splits):
            rows = self.assign(df, k)
            yield rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


class KFold(_Splitter):
    """Contiguous folds in key order; with ``shuffle``, in the order of a hash of the key."""

    def __init__(self, key: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0):
        if n_splits < 2:
            raise ValueError("k-fold cross-validation requires at least one train/test split")
        self.key, self.n_splits, self.shuffle, self.random_state = key, n_splits, shuffle, random_state

    label: str | None = None

    def assign(self, df: DataFrame, name: str = "fold") -> DataFrame:
        order = self.key
        rows = df
        if self.shuffle:
            order = "__order"
            rows = df.withColumn(order, uniform(self.key, self.random_state))
        rows = with_position(rows, order, self.label, "__position")
        if self.label is None:
            total: Column | int = df.count()
        else:
            counts = df.groupBy(F.col(f"`{self.label}`").alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
            rows = rows.join(F.broadcast(counts), F.col(f"`{self.label}`").eqNullSafe(F.col("__label")))  # one row for each class
            total = F.col("__n")
        return rows.withColumn(name, fold_of(F.col("__position"), total, self.n_splits)).select(*[F.col(f"`{c}`") for c in df.columns], name)

    def split(self, df: DataFrame) -> Iterator[Pair]:
        rows = self.assign(df, "__fold").persist()
        for k in range(self.n_splits):
            yield rows.where(F.col("__fold") != k).drop("__fold"), rows.where(F.col("__fold") == k).drop("__fold")


class StratifiedKFold(KFold):
    """Contiguous folds inside each class of ``label``."""

    def __init__(self, key: str, label: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0):
        super().__init__(key, n_splits, shuffle, random_state)
        self.label = label


class PredefinedSplit(_Splitter):
    """Test folds named by an integer column; -1 is in no test fold."""

    def __init__(self, column: str):
        self.column = column

    def split(self, df: DataFrame) -> Iterator[Pair]:
        fold = F.col(f"`{self.column}`")
        for row in df.where(fold >= 0).select(fold.alias("f")).distinct().orderBy("f").collect():
            yield df.where(fold != row["f"]), df.where(fold == row["f"])


class LeaveOneGroupOut(_Splitter):
    def __init__(self, groups: str):
        self.groups = groups

    def split(self, df: DataFrame) -> Iterator[Pair]:
        group = F.col(f"`{self.groups}`")
        for row in df.select(group.alias("g")).distinct().orderBy("g").collect():
            yield df.where(~group.eqNullSafe(F.lit(row["g"]))), df.where(group.eqNullSafe(F.lit(row["g"])))


class LeaveOneOut(_Splitter):
    """Each row is the test part once.  A job for each row: for frames of few rows."""

    def __init__(self, key: str):
        self.key = key

    def split(self, df: DataFrame) -> Iterator[Pair]:
        yield from LeavePOut(self.key, 1).split(df)


class LeavePOut(_Splitter):
    """Each set of ``p`` rows is the test part once, rows told apart by ``key``.  For frames of few rows."""

    def __init__(self, key: str, p: int):
        if p < 1:
            raise ValueError(f"p must be at least 1, not {p}")
        self.key, self.p = key, p

    def split(self, df: DataFrame) -> Iterator[Pair]:
        key = F.col(f"`{self.key}`")
        names = [r["k"] for r in df.select(key.alias("k")).orderBy("k").collect()]
        if len(names) <= self.p:
            raise ValueError(f"{len(names)} rows, more than {self.p} are needed")
        for held in combinations(names, self.p):
            yield df.where(~key.isin(list(held))), df.where(key.isin(list(held)))


class LeavePGroupsOut(_Splitter):
    """Each set of ``n_groups`` groups is the test part once."""

    def __init__(self, groups: str, n_groups: int):
        if n_groups < 1:
            raise ValueError(f"n_groups must be at least 1, not {n_groups}")
        self.groups, self.n_groups = groups, n_groups

    def split(self, df: DataFrame) -> Iterator[Pair]:
        group = F.col(f"`{self.groups}`")
        names = [r["g"] for r in df.select(group.alias("g")).distinct().orderBy("g").collect()]
        if len(names) <= self.n_groups:
            raise ValueError(f"{len(names)} groups, more than {self.n_groups} are needed")
        for held in combinations(names, self.n_groups):
            inside = F.lit(False)
            for name in held:
                inside = inside | group.eqNullSafe(F.lit(name))
            yield df.where(~inside), df.where(inside)


def check_cv(cv: object = None, key: str = "id", label: str | None = None, classifier: bool = False) -> object:
    """None is 3; numbers make stratified folds for classifiers with a label, else plain ones."""
    cv = 3 if cv is None else cv
    if isinstance(cv, int):
        return StratifiedKFold(key, label, cv) if classifier and label else KFold(key, cv)
    return cv


def compute_n_splits(cv: object, df: DataFrame | None = None, leave_out: int | None = None) -> int:
    """Number of splits; looks at data only where it decides."""
    if isinstance(cv, PredefinedSplit):
        return df.where(F.col(f"`{cv.column}`") >= 0).select(cv.column).distinct().count()
    if isinstance(cv, LeaveOneGroupOut):
        groups = df.select(cv.groups).distinct().count()
        return groups if leave_out is None else comb(groups, leave_out)
    if isinstance(cv, LeavePGroupsOut):
        return comb(df.select(cv.groups).distinct().count(), cv.n_groups)
    if isinstance(cv, (LeaveOneOut, LeavePOut)):
        return comb(df.count(), getattr(cv, "p", 1))
    if hasattr(cv, "n_splits"):
        return cv.n_splits
    if isinstance(cv, Iterable):
        return len(list(cv))
    raise ValueError(f"not a cross-validation object: {cv!r}")
