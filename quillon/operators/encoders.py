"""Categories, labels and composition of transformers.

Categories are part of the fitted encoder, sorted, and looked up by a map
literal while they are few, by a join with the fitted table beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.base import Estimator, clone, replaced
from quillon.operators.scalers import PolynomialFeatures

#: Categories up to which a lookup is a map literal.
LITERAL = 1000
#: Categories of one column that may be brought to the driver.
MAX_CATEGORIES = 5_000_000
#: Bytes of categories up to which a join sends them to every task.
BROADCAST_BYTES = 64 << 20


def distinct_sorted(df: DataFrame, name: str) -> list:
    """Sorted distinct values without missing ones; refuses columns that aren't categorical."""
    values = df.select(F.col(f"`{name}`").alias("v")).where("v IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(values) > MAX_CATEGORIES:
        raise ValueError(f"{name} has more than {MAX_CATEGORIES} distinct values")
    return sorted(r["v"] for r in values)


def looked_up(df: DataFrame, name: str, table: DataFrame, key: str, categories: Sequence) -> DataFrame:
    """Left join with a table of categories, each once: a broadcast while their measured size allows.

    Beyond that both sides are shuffled; hot and missing values of ``df`` are then
    for adaptive execution to split, as the table has one row for each.
    """
    size = sum(16 + (len(c.encode("utf-8", "surrogatepass")) if isinstance(c, str) else 16) for c in categories)
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return df.join(table, F.col(f"`{name}`") == F.col(f"`{key}`"), "left")


def coded(df: DataFrame, names: dict[str, Sequence], unknown: str = "null") -> DataFrame:
    """Columns replaced by codes (int) of their categories.

    Missing values get null; other values too, or an error if ``unknown`` is "error".
    """
    new: dict[str, Column] = {}
    for name, categories in names.items():
        column = F.col(f"`{name}`")
        if len(categories) <= LITERAL:
            code = F.lit(None).cast("int")
            if len(categories):
                code = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(categories) for x in (c, k)]), column)
        else:
            table = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(categories)], f"`v_{name}` {dict(df.dtypes)[name]}, `k_{name}` int")
            df = looked_up(df, name, table, f"v_{name}", categories).drop(f"v_{name}")
            code = F.col(f"`k_{name}`")
        if unknown == "error":
            seen = F.concat(F.lit(f"Found unknown category in column {name}: "), column.cast("string"))
            code = F.when(code.isNotNull() | column.isNull(), code).otherwise(F.raise_error(seen).cast("int"))
        new[name] = code
    return replaced(df, new).drop(*[f"k_{n}" for n in names])


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


class _Fitted(Estimator):
    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Categorizer(_Fitted):
    """Learns the categories of columns; values outside of given categories become missing."""

    def __init__(self, categories: dict[str, Sequence] | None = None, columns: Sequence[str] | None = None):
        self.categories, self.columns = categories, columns

    def fit(self, df: DataFrame) -> Categorizer:
        if not isinstance(df, DataFrame):
            raise TypeError("Expected a DataFrame")
        if self.categories is not None:
            self.categories_ = {k: list(v) for k, v in self.categories.items()}
        else:
            names = list(self.columns) if self.columns is not None else string_columns(df)
            self.categories_ = {c: distinct_sorted(df, c) for c in names}
        self.columns_ = list(self.categories_)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("categories_")
        names, new = df.columns, {}
        for k, (name, categories) in enumerate(self.categories_.items()):
            column = F.col(f"`{name}`")
            if len(categories) <= LITERAL:
                known = column.isin(categories) if categories else F.lit(False)
            else:
                # Each category once, so that the join repeats no row.
                kept = [(c,) for c in dict.fromkeys(categories) if c is not None]
                table = df.sparkSession.createDataFrame(kept, f"`__known_{k}` {dict(df.dtypes)[name]}")
                df = looked_up(df, name, table, f"__known_{k}", categories)
                known = F.col(f"__known_{k}").isNotNull()
            new[name] = F.when(known, column)
        return replaced(df, new).select(*[F.col(f"`{c}`") for c in names])


class OrdinalEncoder(_Fitted):
    """Categories to codes, missing values to -1."""

    def __init__(self, columns: Sequence[str] | None = None, categories: dict[str, Sequence] | None = None):
        self.columns, self.categories = columns, categories

    def fit(self, df: DataFrame) -> OrdinalEncoder:
        names = self.columns if self.columns is not None else string_columns(df)
        self.categories_ = {c: list((self.categories or {}).get(c) or distinct_sorted(df, c)) for c in names}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("categories_")
        codes = coded(df, self.categories_)
        return replaced(codes, {c: F.coalesce(F.col(f"`{c}`"), F.lit(-1)) for c in self.categories_})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        back = {c: F.when(F.col(f"`{c}`") >= 0, F.element_at(F.array(*map(F.lit, v)), F.col(f"`{c}`").cast("int") + 1)) for c, v in self.categories_.items()}
        return replaced(df, back)


class DummyEncoder(_Fitted):
    """A 0/1 column ``column_category`` for each category, behind all other columns; missing values have zeros."""

    def __init__(self, columns: Sequence[str] | None = None, drop_first: bool = False, categories: dict[str, Sequence] | None = None):
        self.columns, self.drop_first, self.categories = columns, drop_first, categories

    def fit(self, df: DataFrame) -> DummyEncoder:
        self.columns_ = list(df.columns)
        names = self.columns if self.columns is not None else string_columns(df)
        self.categories_ = {c: list((self.categories or {}).get(c) or distinct_sorted(df, c)) for c in names}
        self.non_categorical_columns_ = [c for c in df.columns if c not in self.categories_]
        at, self.categorical_blocks_ = len(self.non_categorical_columns_), {}
        for c, v in self.categories_.items():
            size = len(v) - bool(self.drop_first and v)
            self.categorical_blocks_[c], at = slice(at, at + size), at + size
        self.transformed_columns_ = [*self.non_categorical_columns_, *[f"{c}_{x}" for c, v in self.categories_.items() for x in v[bool(self.drop_first) :]]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("categories_")
        if list(df.columns) != self.columns_:
            raise ValueError(f"Columns of df do not match those of fit: {df.columns} {self.columns_}")
        made = [
            F.coalesce((F.col(f"`{c}`") == F.lit(x)).cast("int"), F.lit(0)).alias(f"{c}_{x}")
            for c, v in self.categories_.items()
            for x in v[bool(self.drop_first) :]
        ]
        return df.select(*[F.col(f"`{c}`") for c in self.non_categorical_columns_], *made)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """First highest block position; with ``drop_first``, zeros are the first category, else missing."""
        new = {}
        for c, v in self.categories_.items():
            names = [f"{c}_{x}" for x in v[bool(self.drop_first) :]]
            default = F.lit(v[0]) if self.drop_first and v else F.lit(None)
            out = default
            for name, x in reversed(list(zip(names, v[bool(self.drop_first) :], strict=True))):
                out = F.when(F.col(f"`{name}`") > 0, F.lit(x)).otherwise(out)
            new[c] = out
        return df.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in self.columns_])


class OneHotEncoder(_Fitted):
    """Sparse one-hot vectors in ``output`` (size, indices, values), blocks in the order of the columns."""

    def __init__(self, columns: Sequence[str] | None = None, categories: str | Sequence[Sequence] = "auto", drop: object = None, sparse_output: bool = True, handle_unknown: str = "error", output: str = "onehot"):
        self.columns, self.categories, self.drop = columns, categories, drop
        self.sparse_output, self.handle_unknown, self.output = sparse_output, handle_unknown, output

    def fit(self, df: DataFrame) -> OneHotEncoder:
        if self.drop is not None:
            raise NotImplementedError("no category can be dropped: drop must be None")
        if self.handle_unknown == "ignore":
            raise NotImplementedError("unknown categories are errors: handle_unknown must be 'error'")
        if self.handle_unknown != "error":
            raise ValueError(f"handle_unknown should be 'error' or 'ignore', got {self.handle_unknown}")
        self.columns_ = list(self.columns) if self.columns is not None else string_columns(df)
        if isinstance(self.categories, str):
            self.categories_ = [distinct_sorted(df, c) for c in self.columns_]
        else:
            if len(self.categories) != len(self.columns_):
                raise ValueError("Shape mismatch: if categories is an array, it has to be of shape (n_features,).")
            if any(list(c) != sorted(c) for c in self.categories):
                raise ValueError("Unsorted categories are not supported")
            self.categories_ = [list(c) for c in self.categories]
        return self

    def get_feature_names_out(self) -> list[str]:
        return [f"{c}_{x}" for c, v in zip(self.columns_, self.categories_, strict=True) for x in v]

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("categories_")
        offsets = np.cumsum([0, *[len(c) for c in self.categories_]]).tolist()
        names = {f"__code_{k}": v for k, v in enumerate(self.categories_)}
        rows = coded(df.select("*", *[F.col(f"`{c}`").alias(n) for c, n in zip(self.columns_, names, strict=True)]), names, "error")
        hot = F.filter(F.array(*[F.col(n) + o for n, o in zip(names, offsets, strict=False)]), lambda x: x.isNotNull())
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.columns_]
        if self.sparse_output:
            return rows.select(*kept, F.struct(F.lit(offsets[-1]).alias("size"), hot.alias("indices"), F.transform(hot, lambda _: F.lit(1.0)).alias("values")).alias(self.output))
        dense = F.transform(F.sequence(F.lit(0), F.lit(offsets[-1] - 1)), lambda k: F.array_contains(hot, k).cast("double"))
        return rows.select(*kept, dense.alias(self.output))


class LabelEncoder(Estimator):
    """Sorted classes to 0..K-1; unseen labels are an error."""

    def __init__(self, column: str):
        self.column = column

    def fit(self, df: DataFrame) -> LabelEncoder:
        self.classes_ = distinct_sorted(df, self.column)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("classes_")
        return coded(df, {self.column: self.classes_}, "error")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        code = F.col(f"`{self.column}`").cast("int")
        bad = F.raise_error(F.concat(F.lit("unseen code "), code.cast("string")))
        return replaced(df, {self.column: F.when(code.between(0, len(self.classes_) - 1), F.element_at(F.array(*map(F.lit, self.classes_)), code + 1)).otherwise(bad)})


Selector = str | Sequence[str] | Callable[[DataFrame], Sequence[str]]


class ColumnTransformer(_Fitted):
    """Transformers on subsets of columns, their results side by side in the order given, the rest last.

    Transformers are row-local, so that results line up without a join: each is
    applied to copies of its columns and only its own columns are taken.
    """

    def __init__(self, transformers: Sequence[tuple[str, object, Selector]], remainder: object = "drop"):
        self.transformers, self.remainder = transformers, remainder

    @staticmethod
    def _select(df: DataFrame, columns: Selector) -> list[str]:
        if callable(columns):
            columns = columns(df)
        if isinstance(columns, str):
            return [columns]
        if isinstance(columns, slice):
            return df.columns[columns]
        columns = list(columns)
        if columns and all(isinstance(c, (bool, np.bool_)) for c in columns):
            return [c for c, on in zip(df.columns, columns, strict=True) if on]
        return [df.columns[c] if isinstance(c, int) else c for c in columns]

    def fit(self, df: DataFrame) -> ColumnTransformer:
        self.transformers_, used = [], set()
        for name, transformer, columns in self.transformers:
            own = self._select(df, columns)
            used |= set(own)
            if transformer not in ("drop", "passthrough"):
                transformer = clone(transformer).fit(df.select(*[f"`{c}`" for c in own]))
            self.transformers_.append((name, transformer, own))
        rest = [c for c in df.columns if c not in used]
        remainder = self.remainder
        if remainder not in ("drop", "passthrough"):
            remainder = clone(remainder).fit(df.select(*[f"`{c}`" for c in rest]))
        self.transformers_.append(("remainder", remainder, rest))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("transformers_")
        rows, taken = df.select(*[F.col(f"`{c}`").alias(f"__in_{c}") for c in df.columns]), []
        for name, transformer, own in self.transformers_:
            if isinstance(transformer, str):
                if transformer == "passthrough":
                    taken += [(f"__in_{c}", c) for c in own]
                continue
            if not own:
                continue
            # Everything else rides along as one struct that the transformer passes on.
            carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__carried")
            inner = rows.select(*[F.col(f"`__in_{c}`").alias(c) for c in own], carried)
            out = _carrying(transformer).transform(inner)
            made = [c for c in out.columns if c != "__carried"]
            rows = out.select("__carried.*", *[F.col(f"`{c}`").alias(f"__{name}_{c}") for c in made])
            taken += [(f"__{name}_{c}", c) for c in made]
        counts = [c for _, c in taken]
        return rows.select(*[F.col(f"`{c}`").alias(n if counts.count(n) == 1 else c.strip("_")) for c, n in taken])


def _carrying(transformer: Estimator) -> Estimator:
    """The fitted transformer, made to pass on one more column."""
    if not isinstance(transformer, (DummyEncoder, PolynomialFeatures)):
        return transformer
    out = clone(transformer)
    vars(out).update(vars(transformer))
    if isinstance(out, PolynomialFeatures):
        out.preserve = True
    else:
        out.columns_ = [*transformer.columns_, "__carried"]
        out.non_categorical_columns_ = [*transformer.non_categorical_columns_, "__carried"]
    return out


def make_column_transformer(*transformers: tuple[object, Selector], remainder: object = "drop", **unknown: object) -> ColumnTransformer:
    if unknown:
        raise TypeError(f"Unknown keyword arguments: {sorted(unknown)}")
    names: dict[str, int] = {}
    named = []
    for transformer, columns in transformers:
        base = transformer if isinstance(transformer, str) else type(transformer).__name__.lower()
        names[base] = names.get(base, 0) + 1
        named.append((base if names[base] == 1 else f"{base}-{names[base]}", transformer, columns))
    return ColumnTransformer(named, remainder)


class _Nothing(Estimator):
    """Stands for a step that is fitted elsewhere."""

    def __init__(self) -> None:
        pass

    def fit(self, df: DataFrame, *args: object) -> _Nothing:
        return self


class Pipeline(Estimator):
    """Transformers in turn; ``None`` and "passthrough" steps do nothing."""

    def __init__(self, steps: Sequence[tuple[str, object]]):
        self.steps = steps

    def set_params(self, **params: object) -> Pipeline:
        own = dict(self.steps)
        for name, value in params.items():
            step, _, rest = name.partition("__")
            if step not in own:
                raise ValueError(f"Pipeline has no step {step!r}")
            if rest:
                own[step].set_params(**{rest: value})
            else:
                own[step] = value
        self.steps = list(own.items())
        return self

    def fit(self, df: DataFrame, *args: object) -> Pipeline:
        self.fitted_ = []
        steps = [(n, s) for n, s in self.steps if s not in (None, "passthrough")]
        for k, (name, step) in enumerate(steps):
            own = clone(step)
            last = k == len(steps) - 1
            own.fit(df, *(args if last else ()))
            self.fitted_.append((name, own))
            if not last:
                df = own.transform(df)
        return self

    def prefix(self) -> tuple:
        """What the fit of all steps but the last depends on, besides the rows."""
        return tuple((n, repr(s)) for n, s in self.steps[:-1])

    def fit_prefix(self, df: DataFrame) -> list[tuple[str, object]]:
        """All steps but the last, fitted in turn."""
        return Pipeline([*self.steps[:-1], ("last", _Nothing())]).fit(df).fitted_[:-1]

    def fit_last(self, fitted: list[tuple[str, object]], df: DataFrame, *args: object) -> Pipeline:
        """The last step on rows that the ``fitted`` ones have transformed."""
        name, step = self.steps[-1]
        self.fitted_ = [*fitted, (name, clone(step).fit(df, *args))]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.fitted_:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        for _, step in self.fitted_[:-1]:
            df = step.transform(df)
        return self.fitted_[-1][1].predict(df)

    @property
    def _estimator_type(self) -> str:
        return getattr(self.steps[-1][1], "_estimator_type", "")

    def score(self, df: DataFrame, *args: object) -> float:
        for _, step in self.fitted_[:-1]:
            df = step.transform(df)
        return self.fitted_[-1][1].score(df, *args)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class FeatureUnion(Estimator):
    """Transformers side by side on the same rows; the columns that each adds or changes stand behind ``keep``, named ``step__column``.

    One transformer after the other works on the frame, so that rows need no
    join.  A step of ``None`` or "drop" gives nothing, "passthrough" the input's
    own columns.
    """

    def __init__(self, transformer_list: Sequence[tuple[str, object]], keep: Sequence[str] = ()):
        self.transformer_list, self.keep = transformer_list, keep

    def set_params(self, **params: object) -> FeatureUnion:
        own = dict(self.transformer_list)
        for name, value in params.items():
            step, _, rest = name.partition("__")
            if step == "keep":
                self.keep = value
            elif step not in own:
                raise ValueError(f"FeatureUnion has no step {step!r}")
            elif rest:
                own[step].set_params(**{rest: value})
            else:
                own[step] = value
        self.transformer_list = list(own.items())
        return self

    def fit(self, df: DataFrame, *args: object) -> FeatureUnion:
        self.fitted_ = [(n, s if s in (None, "drop", "passthrough") else clone(s).fit(df)) for n, s in self.transformer_list]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check_fitted("fitted_")
        source = "__union_"
        out = df.select(*[F.col(f"`{c}`") for c in self.keep], *[F.col(f"`{c}`").alias(f"{source}{c}") for c in df.columns])
        for name, step in self.fitted_:
            if step in (None, "drop"):
                continue
            done = [c for c in out.columns if not c.startswith(source)]
            # The step sees the input's columns by their own names, all others under names of its own.
            held = {c: f"__held_{k}" for k, c in enumerate(out.columns)}
            frame = out.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()], *[F.col(f"`{source}{c}`").alias(c) for c in df.columns])
            made = frame if step == "passthrough" else step.transform(frame)
            missing = [h for h in held.values() if h not in made.columns]
            if missing:
                raise ValueError(f"step {name!r} doesn't hand on the columns that it doesn't use")
            changed = [c for c in made.columns if c not in held.values() and c not in self.keep]
            out = made.select(
                *[F.col(held[c]).alias(c) for c in done], *[F.col(f"`{c}`").alias(f"{name}__{c}") for c in changed], *[F.col(held[f"{source}{c}"]).alias(f"{source}{c}") for c in df.columns]
            )
        return out.drop(*[f"{source}{c}" for c in df.columns])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def make_pipeline(*steps: object) -> Pipeline:
    return Pipeline([(f"{type(s).__name__.lower()}-{k}", s) for k, s in enumerate(steps)])
