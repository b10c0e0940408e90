"""Unions, shared prefixes in searches, vectorisers by row, validation."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import pairwise, validation
from quillon.operators import ensemble, linear, search, splits, text
from quillon.operators.base import Estimator, arrow_values, clone, matrix
from quillon.operators.encoders import FeatureUnion, Pipeline
from quillon.operators.learners import RidgeRegressor, SGDClassifier
from quillon.operators.scalers import MinMaxScaler, SimpleImputer, StandardScaler
from quillon.streaming.incremental import ModelStore

TEXTS = [(1, "one two two"), (1, "two three"), (None, "one one"), (2, None), (3, ""), (None, "x zzz"), (4, "three " * 3000)]


def frame(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_counts_are_of_the_row_for_repeated_and_null_keys(spark):
    model = text.CountVectorizer().fit(frame(spark))
    assert model.get_feature_names_out() == ["one", "three", "two", "zzz"]
    got = Counter((r["id"], tuple(r["counts"]["indices"]), tuple(r["counts"]["values"]), r["counts"]["size"]) for r in model.transform(frame(spark)).collect())
    want = Counter()
    for key, body in TEXTS:
        terms = Counter(model.vocabulary_[t] for t in re.findall(r"\b\w\w+\b", body or ""))
        at = tuple(sorted(terms))
        want[key, at, tuple(float(terms[k]) for k in at), 4] += 1
    assert got == want
    binary = text.CountVectorizer(binary=True, vocabulary=model.vocabulary_).fit(frame(spark)).term_counts(frame(spark))
    assert {r["count"] for r in binary.collect()} == {1}
    assert "Exchange" not in model.transform(frame(spark))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("norm", [None, "l1", "l2"])
@pytest.mark.parametrize("signed", [True, False])
def test_hashed_terms_against_plain_sums(spark, norm, signed):
    rows = {k: r for k, r in enumerate(text.HashingVectorizer(n_features=8, norm=norm, alternate_sign=signed).transform(frame(spark)).collect())}
    for k, (key, body) in enumerate(TEXTS):
        sums = np.zeros(8)
        for t in re.findall(r"\b\w\w+\b", body or ""):
            h = text.murmur3(t.encode())
            sums[abs(h) % 8] += -1 if signed and h < 0 else 1
        total = 1.0 if norm is None or not sums.any() else np.abs(sums).sum() if norm == "l1" else np.sqrt(sums @ sums)
        got = np.zeros(8)
        got[rows[k]["hashed"]["indices"]] = rows[k]["hashed"]["values"]
        assert rows[k]["id"] == key and np.allclose(got, sums / total)


def test_pairs_with_equal_names_add_up(spark):
    df = spark.createDataFrame([(1, [("a", 1.0), ("a", 2.0), ("b", 3.0)]), (2, None)], "id long, p array<struct<n:string,v:double>>")
    got = text.FeatureHasher("p", 1 << 10, "pair", alternate_sign=False).transform(df).orderBy("id").collect()
    assert sorted(got[0]["hashed"]["values"]) == [3.0, 3.0] and not got[1]["hashed"]["indices"]


def test_union_of_transformers(spark):
    df = spark.createDataFrame([(k, float(k), 2.0 * k + 1) for k in range(20)], "id long, a double, b double")
    union = FeatureUnion([("std", StandardScaler(columns=["a"])), ("mm", MinMaxScaler(columns=["a", "b"])), ("none", "drop"), ("same", "passthrough")], keep=["id"])
    out = union.fit_transform(df).orderBy("id")
    assert out.columns == ["id", "std__a", "std__b", "mm__a", "mm__b", "same__a", "same__b"]
    std, mm = StandardScaler(columns=["a"]).fit_transform(df).orderBy("id").collect(), MinMaxScaler(columns=["a", "b"]).fit_transform(df).orderBy("id").collect()
    for r, s, m, (k, a, b) in zip(out.collect(), std, mm, [tuple(x) for x in df.orderBy("id").collect()], strict=True):
        assert (r["id"], r["std__a"], r["std__b"], r["mm__a"], r["mm__b"], r["same__a"], r["same__b"]) == (k, s["a"], b, m["a"], m["b"], a, b)
    assert union.set_params(std=None).fit_transform(df).columns == ["id", "mm__a", "mm__b", "same__a", "same__b"]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_searches_share_the_fit_of_equal_prefixes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    rows = [(k, float(a), float(b), int(a + b > 0)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    fits = []
    plain = StandardScaler.fit
    monkeypatch.setattr(StandardScaler, "fit", lambda self, *args: (fits.append(1), plain(self, *args))[1])
    pipe = Pipeline([("scale", StandardScaler(columns=["a", "b"])), ("model", linear.LogisticRegression(solver="newton"))])
    found = search.GridSearchCV(pipe, {"model__C": [0.1, 1.0, 10.0]}, cv=2, refit=False).fit(df, ["a", "b"], "y")
    assert found.prefix_fits_ == 2 and len(fits) == 2
    for c, mean in zip((0.1, 1.0, 10.0), found.cv_results_["mean_test_score"], strict=True):
        own = search.GridSearchCV(clone(pipe).set_params(model__C=c), {}, cv=2, refit=False).fit(df, ["a", "b"], "y")
        assert own.cv_results_["mean_test_score"][0] == pytest.approx(mean)
    assert pipe.steps[1][1].C == 1.0  # candidates work on copies


def test_blocks_larger_than_a_call_are_streamed(spark, monkeypatch):
    calls = []

    class Learner:
        def partial_fit(self, x, y, **kw):
            calls.append((len(x), y.tolist()))

    df = spark.createDataFrame([(k, [float(k)], k) for k in range(100)], "id long, x array<double>, y long")
    monkeypatch.setattr(ensemble, "CALL_ROWS", 30)
    ensemble.sequential_fit(Learner(), df, "x", "y", "id", 1, [0])
    assert [n for n, _ in calls] == [30, 30, 30, 10] and sum((y for _, y in calls), []) == list(range(100))


def test_matrices_of_rows_of_several_widths_are_refused():
    import pandas as pd
    import pyarrow as pa

    good, bad = [[1.0, 2.0], [3.0, 4.0]], [[1.0], [2.0, 3.0, 4.0]]
    assert np.array_equal(arrow_values(pa.array(good)), good) and np.array_equal(matrix(pd.Series([np.array(g) for g in good])), good)
    assert np.array_equal(arrow_values(pa.array([[0.0, 0.0], *good]).slice(1)), good)
    with pytest.raises(ValueError):
        arrow_values(pa.array(bad))
    with pytest.raises(ValueError):
        matrix(pd.Series([np.array(b) for b in bad]))


def test_leave_out_splits(spark):
    df = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(6)], "id long, g string")
    for cv, n, size in ((splits.LeaveOneOut("id"), 6, 1), (splits.LeavePOut("id", 2), 15, 2), (splits.LeavePGroupsOut("g", 2), 3, 4)):
        made = [(frozenset(r["id"] for r in a.collect()), frozenset(r["id"] for r in b.collect())) for a, b in cv.split(df)]
        assert len(set(made)) == len(made) == n == splits.compute_n_splits(cv, df)
        assert all(not a & b and a | b == set(range(6)) and len(b) == size for a, b in made)
    with pytest.raises(ValueError):
        list(splits.LeavePGroupsOut("g", 3).split(df))


def test_distances_keep_their_digits_for_many_rows(spark):
    """Far from the origin, and beyond the size of literals in a plan."""
    rng = np.random.default_rng(0)
    x = 1e6 + rng.normal(size=(20, 8)) * 1e-3
    y = np.vstack([x, 1e6 + rng.normal(size=(pairwise.LITERAL_CELLS // 8, 8))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    for r in pairwise.euclidean_distances(df, "x", y).collect():
        assert np.allclose(r["distances"], np.sqrt(((x[r["id"]] - y) ** 2).sum(1)), rtol=1e-9, atol=1e-12)


def test_most_frequent_and_approximate_medians(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (2.0, "b"), (2.0, "a"), (None, None), (9.0, "c")], "v double, s string")
    assert SimpleImputer("most_frequent", columns=["v", "s"]).fit(df).statistics_ == [1.0, "a"]
    assert SimpleImputer("median", columns=["v"], accuracy=100).fit(df).statistics_ == [2.0]
    empty = df.where("v IS NULL")
    assert SimpleImputer("most_frequent", columns=["v"]).fit(empty).statistics_ == [None]


def test_model_store_keeps_the_last_versions(spark, tmp_path):
    store = ModelStore(f"file://{tmp_path}/models")
    assert store.load() is None
    for k in range(4):
        store.save(k, {"model": k})
    assert store.versions() == [2, 3] and ModelStore(f"{tmp_path}/models").load() == (3, {"model": 3})


def test_validation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0, "s"), (2, [3.0, 4.0], 2.0, "t")], "id long, x array<double>, y double, s string")
    assert validation.check_array(df, "x") == 2 and validation.check_array(df, ["id", "y"]) == 2 and validation.check_x_y(df, "x", "y") == 2
    for features, error in (("s", TypeError), (["s"], TypeError), ("none", ValueError), (["y", "none"], ValueError)):
        with pytest.raises(error):
            validation.check_array(df, features)
    ragged = df.withColumn("x", F.expr("if(id = 1, array(1D), x)"))
    holes = df.withColumn("x", F.expr("if(id = 1, array(1D, double('nan')), x)"))
    for bad in (ragged, holes, df.limit(0)):
        with pytest.raises(ValueError):
            validation.check_array(bad, "x")
    assert validation.check_array(holes, "x", allow_missing=True) == 2
    with pytest.raises(ValueError):
        validation.check_x_y(df.withColumn("y", F.lit(None).cast("double")), "x", "y")
    assert validation.check_blocks(1000, 5) == (125, 5) and validation.check_blocks(100, 5, 40) == (40, 5) and validation.check_blocks(10, 5) == (100, 5)
    with pytest.raises(ValueError):
        validation.check_blocks(100, 5, (10, 3))
    a, b = (StandardScaler(columns=["y"]).fit(df) for _ in range(2))
    validation.assert_estimator_equal(a, b)
    with pytest.raises(AssertionError):
        validation.assert_estimator_equal(a, StandardScaler(columns=["y"]).fit(df.where("id = 1")))
    with pytest.raises(ValueError):
        validation.check_n_features(linear.LinearRegression(solver="newton").fit(df, ["y"], "y"), df, "x")
    took: list = []
    with validation.timer("step", sink=took):
        pass
    assert took[0][0] == "step" and validation.num_rows(df) == 2 == validation.num_rows([1, 2])


class Watched(Estimator):
    """Keeps the number of rows of each call and what tells their order."""

    def __init__(self, value: float = 0.0):
        self.value = value

    @staticmethod
    def mark(ids):
        return (len(ids), sum(k * int(v) for k, v in enumerate(ids)), sum(int(v) % 3 for v in ids))

    def partial_fit(self, x, y):
        assert (x[:, 0] % 3 == y).all()
        self.calls_ = [*getattr(self, "calls_", []), self.mark(x[:, 0])]
        return self


def test_rounds_stream_blocks_in_order_and_hold_a_piece(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    rounds = search.Rounds(rows, "x", "y", "id", 2, 0.0, 0, {})
    blocks = [sorted(r["id"] for r in rows.where(ensemble.block_of("id", 2) == b).select("id").collect()) for b in (0, 1)]
    whole = rounds.advance({0: Watched(), 1: Watched()}, {0: (0, 3), 1: (1, 2)})
    assert whole[0].calls_ == [Watched.mark(blocks[rounds.block(c)]) for c in range(3)] and whole[1].calls_ == whole[0].calls_[1:2]
    rounds.fit_kw["classes"] = [0, 1, 2]
    one = rounds.advance({0: SGDClassifier()}, {0: (0, 3)})[0]
    rounds.cells = 2 * 150
    cut = rounds.advance({0: SGDClassifier()}, {0: (0, 3)})[0]
    assert np.array_equal(one.coef_, cut.coef_) and one.t_ == cut.t_ > 0
    rounds.fit_kw.clear()
    parts = rounds.advance({0: Watched()}, {0: (0, 3)})[0].calls_
    want = [Watched.mark(blocks[rounds.block(c)][k : k + 128]) for c in range(3) for k in range(0, len(blocks[rounds.block(c)]), 128)]
    assert parts == want and len(parts) > 9
    rounds.close()


def test_terms_are_hashed_side_by_side():
    import pyarrow as pa

    terms = ["", "a", "ab", "abc", "abcd", "żółw", "語語語", "x" * 255, "x" * 256, "y" * 257, "z" * 1001, *[str(k) * (k % 9) for k in range(500)]]
    want = [text.murmur3(t.encode()) for t in terms]
    assert min(want) < 0 < max(want) and text.murmur3_each(pa.array(terms)).tolist() == want
    assert text.murmur3_each(pa.array(terms).slice(3, 6)).tolist() == want[3:9] and text.murmur3_each(pa.array([], pa.string())).tolist() == []


def test_vectorisers_work_on_slices_of_bounded_terms(spark, monkeypatch):
    import pyarrow as pa

    lists = pa.array([["a"] * n for n in (3, 0, 4, 9, 1)] + [None])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], ["k", "t"])
    assert [s.column(0).to_pylist() for s in text._slices(iter([batch]), 1, 5)] == [[0, 1], [2], [3], [4, 5]]
    assert [s.column(0).to_pylist() for s in text._slices(iter([batch]), 1, 100)] == [[0, 1, 2, 3, 4, 5]]
    made = [m.transform(frame(spark)).collect() for m in (text.HashingVectorizer(n_features=8), text.CountVectorizer().fit(frame(spark)))]
    monkeypatch.setattr(text, "SLICE_TERMS", 4)
    assert made == [m.transform(frame(spark)).collect() for m in (text.HashingVectorizer(n_features=8), text.CountVectorizer().fit(frame(spark)))]


class Counted(RidgeRegressor):
    def partial_fit(self, x, y):
        self.most_ = max(getattr(self, "most_", 0), len(x))
        return super().partial_fit(x, y)


def test_blocks_of_additive_learners_come_in_pieces(spark):
    rows = spark.range(2000).select("id", F.array(F.col("id") / 2000, F.lit(1.0)).alias("x"), (F.col("id") % 3).cast("int").alias("y"), F.lit("a").alias("s"))
    for learner, model in ((Counted(), ensemble.BlockwiseVotingRegressor), (SGDClassifier(), lambda e, **k: ensemble.BlockwiseVotingClassifier(e, "hard", [0, 1, 2], **k))):
        whole, cut = model(learner, n_blocks=3), model(learner, n_blocks=3)
        cut.cells = 2 * 150
        whole.fit(rows, "x", "y")
        cut.fit(rows, "x", "y")
        for a, b, n in zip(whole.estimators_, cut.estimators_, range(3), strict=True):
            own = np.array([[*r["x"], r["y"]] for r in rows.where(ensemble.block_of("id", 3) == n).orderBy("id").collect()])
            assert np.allclose(a.coef_, b.coef_, atol=1e-9) and np.array_equal(a.coef_, clone(learner).fit(own[:, :2], own[:, 2].astype(int)).coef_)
            assert not hasattr(b, "most_") or b.most_ == 128 and a.most_ == len(own)
        assert cut.predict(rows).where("s = 'a' AND prediction IS NOT NULL").count() == 2000


@pytest.mark.parametrize("made, kind", [([1, 2], "bigint"), ([1, 2], "double"), (["a", "b"], "string"), ([[1.0, 2.0], [3.0, 4.0]], "array<double>"), ([True, False], "boolean")])
def test_models_give_columns_of_each_kind(spark, made, kind):
    df = spark.createDataFrame([(1, [1.0], None), (None, [2.0], "u")], "id long, x array<double>, s string").coalesce(1)
    out = ensemble.apply_model(df, "x", lambda x: np.array(made)[x[:, 0].astype(int) - 1], "out", kind=kind)
    assert dict(out.dtypes)["out"] == kind and [tuple(r) for r in out.select("id", "s", "out").collect()] == [(1, None, made[0]), (None, "u", made[1])]


def test_voting_regressor_range_starts_two_python_workers_a_task(spark, sf_dir):
    from quillon.plans import registry

    plan = registry.queries()["voting_regressor_range"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 2


def test_solvers_pass_over_packed_rows(spark):
    from quillon.operators import base

    df = spark.range(5000, numPartitions=8).select((F.col("id") % 2).cast("double").alias("y"), F.array(F.col("id") / 5000, F.lit(2.0)).alias("x"))
    rows = base.kept_packed(df, ones=True)
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 8
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 3) for r in rows.collect()])
    assert np.array_equal(np.sort(x[:, 0]), np.arange(5000) / 5000) and set(map(tuple, x[:, 1:])) == {(2.0, 1.0)}
    for size in (3, base.DIRECT_SUMS + 3):
        got = base.packed_sums(rows, lambda x, y, size=size: np.concatenate((np.zeros(size - 3), [len(y), x[:, 0].sum(), y.sum()])), size)
        assert len(got) == size and np.allclose(got[-3:], [5000, 2499.5, 2500]) and not got[:-3].any()
    assert not base.packed_sums(base.kept_packed(df.where("y > 7")), lambda x, y: np.ones(2), 2).any()
    rows.unpersist()
