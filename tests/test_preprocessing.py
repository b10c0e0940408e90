"""Scalers, imputation and encoders on small frames with known results."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException

from quillon.operators import encoders as E
from quillon.operators import scalers as S
from quillon.operators.base import NotFittedError, clone

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 3)) * [1, 10, 0] + [0, 5, 7]
    return x, spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double")


def values(df, names=("a", "b", "c")) -> np.ndarray:
    return np.array([[r[n] for n in names] for r in df.orderBy("id").collect()], dtype=float)


def test_standard_scaler(numbers):
    x, df = numbers
    scaler = S.StandardScaler(["a", "b", "c"]).fit(df)
    assert np.allclose(scaler.mean_, x.mean(0)) and np.allclose(scaler.var_, x.var(0)) and scaler.scale_[2] == 1 and scaler.n_samples_seen_ == 100
    want = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    assert np.allclose(values(scaler.transform(df)), want)
    assert np.allclose(values(scaler.inverse_transform(scaler.transform(df))), x)
    plain = S.StandardScaler(["a"], with_mean=False, with_std=False).fit_transform(df)
    assert np.allclose(values(plain, ["a"])[:, 0], x[:, 0])
    with pytest.raises(NotImplementedError):
        scaler.partial_fit(df)
    with pytest.raises(NotFittedError):
        S.StandardScaler().transform(df)


def test_missing_values_are_skipped_and_kept(spark):
    df = spark.createDataFrame([(0, 1.0), (1, NAN), (2, None), (3, 3.0)], "id long, a double")
    scaler = S.StandardScaler(["a"]).fit(df)
    assert scaler.mean_[0] == 2 and scaler.n_samples_seen_ == 4
    assert [r["a"] for r in scaler.transform(df).orderBy("id").collect()] == [-1.0, None, None, 1.0]


def test_minmax_and_robust_scalers(numbers):
    x, df = numbers
    scaler = S.MinMaxScaler((-1, 3), ["a", "b", "c"]).fit(df)
    out = values(scaler.transform(df))
    assert np.allclose(out[:, :2].min(0), -1) and np.allclose(out[:, :2].max(0), 3) and np.allclose(out[:, 2], -1)
    assert np.allclose(values(scaler.inverse_transform(scaler.transform(df))), x)
    robust = S.RobustScaler(columns=["a", "b", "c"]).fit(df)
    q = np.percentile(x, [25, 50, 75], axis=0)
    assert np.allclose(robust.center_, q[1]) and np.allclose(robust.scale_, np.where(q[2] == q[0], 1, q[2] - q[0]))
    assert np.allclose(values(robust.inverse_transform(robust.transform(df))), x)
    with pytest.raises(ValueError):
        S.MinMaxScaler((1, 1)).fit(df)
    with pytest.raises(ValueError):
        S.RobustScaler(quantile_range=(90, 10)).fit(df)


@pytest.mark.parametrize("kind", ["uniform", "normal"])
def test_quantile_transformer(numbers, kind):
    x, df = numbers
    model = S.QuantileTransformer(50, kind, ["a", "b"]).fit(df)
    out = values(model.transform(df), ["a", "b"])
    assert (np.argsort(out[:, 0]) == np.argsort(x[:, 0])).all()
    if kind == "uniform":
        assert out.min() == 0 and out.max() == 1 and abs(np.sort(out[:, 0]) - np.linspace(0, 1, 100)).max() < 0.02
    else:
        assert abs(np.median(out)) < 0.05 and np.abs(out).max() < 5.3
    back = values(model.inverse_transform(model.transform(df)), ["a", "b"])
    assert np.allclose(back, x[:, :2], atol=1e-6)


def test_polynomial_features(numbers):
    x, df = numbers
    model = S.PolynomialFeatures(3, columns=["a", "b"], preserve=True).fit(df)
    terms = [t for d in range(4) for t in combinations_with_replacement(range(2), d)]
    assert model.powers_ == terms
    assert model.get_feature_names_out() == ["1", "a", "b", "a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]
    out = model.transform(df)
    got = np.array([[r[n] for n in model.get_feature_names_out()] for r in out.orderBy("id").collect()])
    assert np.allclose(got, np.column_stack([np.prod(x[:, list(t)], axis=1) for t in terms]))
    assert S.PolynomialFeatures((2, 2), interaction_only=True, columns=["a", "b", "c"]).fit(df).get_feature_names_out() == ["a b", "a c", "b c"]
    with pytest.raises(ValueError):
        S.PolynomialFeatures(-1).fit(df)


@pytest.mark.parametrize("strategy, want", [("mean", 1.5), ("median", 1.5), ("constant", 9.0)])
def test_imputer(spark, strategy, want):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 1.0, NAN, None, 2.0, 2.0])], "id long, a double")
    model = S.SimpleImputer(strategy, 9.0 if strategy == "constant" else None, ["a"]).fit(df)
    assert model.statistics_ == [want]
    assert values(model.transform(df), ["a"])[:, 0].tolist() == [1, 1, want, want, 2, 2]


def test_imputer_most_frequent_and_errors(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["b", "a", None, "b", "a"])], "id long, a string")
    assert S.SimpleImputer("most_frequent", columns=["a"]).fit(df).statistics_ == ["a"]
    with pytest.raises(ValueError):
        S.SimpleImputer("mode").fit(df)
    with pytest.raises(NotImplementedError):
        S.SimpleImputer(add_indicator=True).fit(df)
    with pytest.raises(ValueError):
        S.SimpleImputer("mean", missing_values=0).fit(df)


@pytest.fixture(scope="module")
def categories(spark):
    rows = [(0, "a", "x", 1), (1, "b", None, 2), (2, "a", "y", 3), (3, "c", "x", 4)]
    return spark.createDataFrame(rows, "id long, A string, B string, D int")


def test_ordinal_and_dummy_encoders(categories):
    ordinal = E.OrdinalEncoder(["A", "B"]).fit(categories)
    out = ordinal.transform(categories)
    assert [(r["A"], r["B"], r["D"]) for r in out.orderBy("id").collect()] == [(0, 0, 1), (1, -1, 2), (0, 1, 3), (2, 0, 4)]
    assert sorted(map(tuple, ordinal.inverse_transform(out).collect())) == sorted(map(tuple, categories.collect()))
    for drop in (False, True):
        dummy = E.DummyEncoder(["A", "B"], drop_first=drop).fit(categories)
        out = dummy.transform(categories)
        assert out.columns == dummy.transformed_columns_
        back = {r["id"]: (r["A"], r["B"]) for r in dummy.inverse_transform(out).collect()}
        assert back == {0: ("a", "x"), 1: ("b", "x" if drop else None), 2: ("a", "y"), 3: ("c", "x")}
    with pytest.raises(ValueError):
        dummy.transform(categories.drop("D"))


def test_categorizer(categories):
    model = E.Categorizer({"A": ["a", "b"]}).fit(categories)
    assert [r["A"] for r in model.transform(categories).orderBy("id").collect()] == ["a", "b", "a", None]
    assert E.Categorizer().fit(categories).categories_ == {"A": ["a", "b", "c"], "B": ["x", "y"]}
    with pytest.raises(TypeError):
        E.Categorizer().fit([1, 2])


def test_onehot_and_label_encoders(categories, spark):
    encoder = E.OneHotEncoder(["A"]).fit(categories)
    assert [r["onehot"]["indices"] for r in encoder.transform(categories).orderBy("id").collect()] == [[0], [1], [0], [2]]
    dense = E.OneHotEncoder(["A"], sparse_output=False).fit(categories).transform(categories)
    assert dense.orderBy("id").first()["onehot"] == [1, 0, 0]
    labels = E.LabelEncoder("A").fit(categories)
    assert labels.classes_ == ["a", "b", "c"]
    assert sorted(map(tuple, labels.inverse_transform(labels.transform(categories)).collect())) == sorted(map(tuple, categories.collect()))
    strange = spark.createDataFrame([(9, "z", "x", 1)], categories.schema)
    for made in (encoder, labels):
        with pytest.raises((SparkRuntimeException, PythonException)):
            made.transform(strange).collect()
    for wrong in ({"drop": "first"}, {"handle_unknown": "ignore"}):
        with pytest.raises(NotImplementedError):
            E.OneHotEncoder(["A"], **wrong).fit(categories)
    with pytest.raises(ValueError):
        E.OneHotEncoder(["A"], categories=[["b", "a", "c"]]).fit(categories)


@pytest.mark.parametrize("limit", [0, E.BROADCAST_BYTES])
def test_many_categories_use_a_join(spark, monkeypatch, limit):
    monkeypatch.setattr(E, "LITERAL", 3)
    monkeypatch.setattr(E, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(k, f"v{k % 7}") for k in range(20)] + [(99, None)], "id long, A string")
    made = E.OrdinalEncoder(["A"]).fit_transform(df)
    assert ("strategy=broadcast" in made._jdf.queryExecution().optimizedPlan().toString()) == bool(limit)
    assert {r["id"]: r["A"] for r in made.collect()} == {k: k % 7 for k in range(20)} | {99: -1}
    known = E.Categorizer({"A": [f"v{k}" for k in range(5)]}).fit(df).transform(df)
    assert {r["id"]: r["A"] for r in known.collect()} == {k: f"v{k % 7}" if k % 7 < 5 else None for k in range(20)} | {99: None}


def test_column_transformer(categories):
    made = E.ColumnTransformer([("s", S.StandardScaler(), ["D"]), ("d", E.DummyEncoder(), ["A"]), ("p", S.PolynomialFeatures(2, include_bias=False), [3])], "passthrough")
    out = made.fit(categories).transform(categories)
    assert out.columns == ["s_D", "A_a", "A_b", "A_c", "p_D", "D^2", "id", "B"]
    row = out.where("id = 3").first()
    assert (row["A_c"], row["D^2"], row["B"]) == (1, 16.0, "x") and math.isclose(row["s_D"], 1.5 / np.std([1, 2, 3, 4]))
    with pytest.raises(TypeError):
        E.make_column_transformer((S.StandardScaler(), ["D"]), sparse=1)


def test_params_and_pipeline(numbers):
    _, df = numbers
    pipe = E.Pipeline([("one", S.StandardScaler(["a"])), ("none", None), ("two", S.MinMaxScaler(columns=["a"]))])
    out = values(pipe.fit_transform(df), ["a"])
    assert out.min() == pytest.approx(0) and out.max() == pytest.approx(1)
    pipe.set_params(one__with_mean=False)
    assert pipe.steps[0][1].with_mean is False
    with pytest.raises(ValueError):
        pipe.set_params(three=1)
    copy = clone(S.MinMaxScaler((0, 5), ["a"]))
    assert copy.get_params() == {"feature_range": (0, 5), "columns": ["a"]}
    with pytest.raises(ValueError):
        copy.set_params(nothing=1)


@pytest.mark.parametrize("n", [E.LITERAL, E.LITERAL + 1])
def test_categorizer_drops_unseen_values_on_both_sides_of_the_limit(spark, n):
    seen = spark.createDataFrame([(k, f"c{k}") for k in range(n)], "id long, a string")
    rows = spark.createDataFrame([("c0", 1), ("c0", 2), ("unseen", 3), (None, 4), (f"c{n - 1}", 5)], "a string, id long")
    made = E.Categorizer(columns=["a"]).fit(seen).transform(rows)
    assert made.columns == ["a", "id"]
    assert [(r["id"], r["a"]) for r in made.orderBy("id").collect()] == [(1, "c0"), (2, "c0"), (3, None), (4, None), (5, f"c{n - 1}")]
    given = E.Categorizer({"a": [f"c{k}" for k in range(n - 1)] + ["c0"]}).fit(seen).transform(rows)
    assert [(r["id"], r["a"]) for r in given.orderBy("id").collect()] == [(1, "c0"), (2, "c0"), (3, None), (4, None), (5, None)]
