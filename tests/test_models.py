"""Models, clustering, decomposition, text, ensembles, searches and streams against NumPy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.functions import pairwise as P
from quillon.functions.positions import with_position
from quillon.operators import cluster, decomposition, ensemble, linear, search, splits, text
from quillon.operators.learners import ConstantFunction, LinearFunction, RidgeRegressor, SGDClassifier
from quillon.sources import generators
from quillon.streaming.incremental import StreamingIncremental, windowed_moments


def frame(spark, x, y=None):
    rows = [(k, [float(v) for v in r], None if y is None else float(y[k])) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double")


def column(df, name: str) -> np.ndarray:
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -2, 0] + 0.5)))).astype(float)
    return x, y, frame(spark, x, y).persist()


def objective(x, y, beta, lam, l1):
    eta = x @ beta
    return (np.logaddexp(0, eta) - y * eta).sum() + lam * (l1 * np.abs(beta).sum() + (1 - l1) * beta @ beta / 2)


@pytest.mark.parametrize("solver, penalty", [("lbfgs", "l2"), ("proximal_grad", "l2"), ("proximal_grad", "l1"), ("admm", "l1"), ("admm", "l2"), ("proximal_grad", "elastic_net")])
def test_penalised_logistic_solvers_reach_the_optimum(binary, solver, penalty):
    x, y, df = binary
    x1 = np.column_stack((x, np.ones(len(x))))
    model = linear.LogisticRegression(penalty, C=0.2, solver=solver, tol=1e-5, max_iter=60).fit(df, "x", "y")
    beta, l1 = np.append(model.coef_, model.intercept_), linear.PENALTIES[penalty].l1
    best = beta.copy()
    for _ in range(4000):  # proximal gradient in NumPy
        g = x1.T @ (1 / (1 + np.exp(-x1 @ best)) - y)
        best = linear.PENALTIES[penalty].prox(best - 0.01 * g, 5.0, 0.01)
    assert objective(x1, y, beta, 5.0, l1) <= objective(x1, y, best, 5.0, l1) + 1e-3


@pytest.mark.parametrize("solver", ["newton", "gradient_descent"])
def test_plain_logistic(binary, solver):
    x, y, df = binary
    model = linear.LogisticRegression(solver=solver).fit(df, "x", "y")
    x1 = np.column_stack((x, np.ones(len(x))))
    eta = x1 @ np.append(model.coef_, model.intercept_)
    assert np.abs(x1.T @ (1 / (1 + np.exp(-eta)) - y)).max() < 0.05
    assert model.score(df, "y") == pytest.approx(((eta > 0) == y).mean())
    assert np.allclose(column(model.predict_proba(df), "probability")[:, 1], 1 / (1 + np.exp(-eta)))


def test_linear_poisson_and_errors(spark, binary):
    x, _, df = binary
    y = x @ [2, 0, -1] + 3
    exact = linear.LinearRegression(solver="newton").fit(frame(spark, x, y), "x", "y")
    assert np.allclose(exact.coef_, [2, 0, -1]) and exact.intercept_ == pytest.approx(3) and exact.score(frame(spark, x, y), "y") == pytest.approx(1)
    counts = np.random.default_rng(0).poisson(np.exp(x @ [0.5, 0.2, 0] + 0.3))
    model = linear.PoissonRegression(solver="newton").fit(frame(spark, x, counts), "x", "y")
    mu = np.exp(x @ model.coef_ + model.intercept_)
    assert np.abs(x.T @ (mu - counts)).max() < 0.01
    safe = np.where(counts > 0, counts, 1)
    want = 2 * (np.where(counts > 0, counts * np.log(safe / mu), 0) - (counts - mu)).sum()
    assert model.get_deviance(frame(spark, x, counts), "y") == pytest.approx(want)
    with pytest.raises(ValueError):
        linear.LinearRegression(solver="magic").fit(df, "x", "y")
    with pytest.raises(ValueError):
        linear.add_intercept(df.withColumn("intercept", F.lit(1)))


def test_gaussian_nb(binary):
    x, y, df = binary
    model = linear.GaussianNB().fit(df, "x", "y")
    theta = np.array([x[y == c].mean(0) for c in (0, 1)])
    var = np.array([x[y == c].var(0) for c in (0, 1)])
    jll = np.array([np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * var[c]) + (x - theta[c]) ** 2 / var[c]).sum(1) for c in (0, 1)]).T
    assert np.allclose(model.theta_, theta) and np.allclose(model.sigma_, var)
    assert (column(model.predict(df), "prediction") == jll.argmax(1)).all()
    p = np.exp(jll - jll.max(1, keepdims=True))
    assert np.allclose(column(model.predict_proba(df), "probability"), p / p.sum(1, keepdims=True))


@pytest.mark.parametrize("init", ["k-means||", "k-means++", "random"])
def test_kmeans_on_clear_blobs(spark, init):
    centers = np.array([[-7, -7], [0, 0], [7, 7]])
    df = generators.make_blobs(spark, 300, centers=centers, cluster_std=0.1)
    model = cluster.KMeans(3, init=init, random_state=2, key="id").fit(df, "x")
    if init != "random":
        assert np.allclose(sorted(model.cluster_centers_.tolist()), centers, atol=0.1)
    x = column(df, "x")
    d = ((x[:, None] - model.cluster_centers_) ** 2).sum(2)
    assert model.inertia_ == pytest.approx(d.min(1).sum())
    assert (column(model.predict(df), "prediction") == d.argmin(1)).all()
    assert np.allclose(column(model.transform(df), "distances"), np.sqrt(d))


def test_kmeans_plus_plus_seeds_a_small_far_cluster(spark):
    x = np.random.default_rng(0).normal(size=(20_000, 2))
    x[[5, 7000, 19_000]] += 1e4
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>")
    for key in ("id", None):
        seeds = cluster.KMeans(2, init="k-means++", key=key, random_state=1, max_iter=0).fit(df, "x").cluster_centers_
        assert seeds.max() > 5000 and seeds.min() < 100
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "id long, x array<double>")
    assert np.allclose(cluster.KMeans(3, init="k-means++", max_iter=0).fit(same, "x").cluster_centers_, [1.0, 2.0])


def test_kmeans_errors(spark):
    good = frame(spark, [[0, 1], [1, 0]])
    for bad in (frame(spark, [[0, float("nan")], [1, 1]]), frame(spark, [[0, float("inf")], [1, 1]]), good.limit(0)):
        with pytest.raises(ValueError):
            cluster.KMeans(2).fit(bad, "x")
    with pytest.raises(ValueError):
        cluster.KMeans(2, init="magic").fit(good, "x")
    with pytest.raises(ValueError):
        cluster.KMeans(2, init=np.zeros((3, 2))).fit(good, "x")
    with pytest.raises(ValueError):
        cluster.SpectralClustering(2, n_components=5).fit(good, "x")


def test_spectral_clustering_splits_rings(spark):
    rng = np.random.default_rng(0)
    angle = rng.random(400) * 2 * np.pi
    radius = np.where(np.arange(400) % 2, 1.0, 6.0)
    df = frame(spark, np.column_stack((np.cos(angle), np.sin(angle))) * radius[:, None])
    got = column(cluster.SpectralClustering(2, gamma=0.8, n_components=150, key="id").fit_predict(df, "x"), "prediction")
    agree = (got == np.arange(400) % 2).mean()
    assert max(agree, 1 - agree) > 0.97


def test_pca_family(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 100
    df = frame(spark, x)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    model = decomposition.PCA(3).fit(df, "x")
    assert np.allclose(model.singular_values_, s[:3]) and np.allclose(np.abs(model.components_ @ vt[:3].T), np.eye(3), atol=1e-8)
    assert np.allclose(model.explained_variance_ratio_, (s**2 / (s**2).sum())[:3])
    out = model.transform(df)
    assert np.allclose(np.abs(column(out, "pca")), np.abs(u[:, :3] * s[:3]))
    full = decomposition.PCA().fit(df, "x")
    assert np.allclose(column(full.inverse_transform(full.transform(df)), "restored"), x)
    white = column(decomposition.PCA(2, whiten=True).fit(df, "x").transform(df), "pca")
    assert np.allclose(white.std(0, ddof=1), 1)
    cov = np.cov(x.T)
    dev = x - x.mean(0)
    want = -0.5 * (np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev) + 6 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1])
    assert full.score(df) == pytest.approx(want.mean())
    with pytest.raises(ValueError):
        decomposition.PCA(7).fit(df, "x")
    with pytest.raises(NotImplementedError):
        decomposition.PCA(0.5).fit(df, "x")
    with pytest.raises(TypeError):
        decomposition.PCA(2).fit(x, "x")
    inc = decomposition.IncrementalPCA(6, batch_size=50).fit(df.coalesce(1), "x")
    assert np.allclose(inc.mean_, x.mean(0)) and np.allclose(inc.singular_values_, s)
    svd = decomposition.TruncatedSVD(2).fit(df, "x")
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(svd.singular_values_, s[:2]) and np.allclose(svd.explained_variance_, (u[:, :2] * s[:2]).var(0))
    with pytest.raises(ValueError):
        decomposition.TruncatedSVD(6).fit(df, "x")


def test_pairwise(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((30, 4)), rng.random((7, 4))
    df = frame(spark, x)
    d2 = ((x[:, None] - y) ** 2).sum(2)
    for cells in (4096, 1):
        P.LITERAL_CELLS = cells
        assert np.allclose(column(P.euclidean_distances(df, "x", y), "distances"), np.sqrt(d2))
        assert np.allclose(column(P.pairwise_kernels(df, "x", y, "rbf", gamma=2.0), "kernel"), np.exp(-2 * d2))
        assert np.allclose(column(P.polynomial_kernel(df, "x", y, 2, 0.5, 3), "kernel"), (0.5 * x @ y.T + 3) ** 2)
    P.LITERAL_CELLS = 4096
    found = P.pairwise_distances_argmin_min(df, "x", np.vstack((y, y)))
    assert (column(found, "nearest") == d2.argmin(1)).all()
    city = P.pairwise_distances(df, "x", y, lambda a, b: np.abs(a[:, None] - b).sum(2))
    assert np.allclose(column(city, "distances"), np.abs(x[:, None] - y).sum(2))
    for error, call in ((TypeError, lambda: P.linear_kernel(df, "x", df)), (ValueError, lambda: P.linear_kernel(df, "x", y[:, :2])), (ValueError, lambda: P.pairwise_kernels(df, "x", y, "magic")), (NotImplementedError, lambda: P.pairwise_kernels(df, "x", y, np.dot))):
        with pytest.raises(error):
            call()


def test_metric_options(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 3.0), (1, -2.0, -2.5, 1.0, 0.0)], "id long, a double, p double, b double, q double")
    assert M.mean_squared_error(df, ["a", "b"], ["p", "q"], multioutput="raw_values") == [0.625, 0.5]
    assert M.mean_squared_error(df, ["a", "b"], ["p", "q"]) == 0.5625
    assert M.mean_absolute_percentage_error(df, "a", "p") == pytest.approx(0.625)
    assert M.mean_absolute_percentage_error(df, "a", "p", compat=True) > 1e15
    assert M.r2_score(df.withColumn("k", F.lit(1.0)), "k", "k") == 1.0 and M.r2_score(df.withColumn("k", F.lit(1.0)), "k", "p") == 0.0
    assert M.accuracy_score(df, ["a", "b"], ["a", "q"], normalize=False) == 1
    multi = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (3, [0.1, 0.1, 0.8])], "y int, p array<double>")
    assert M.log_loss(multi, "y", "p", labels=[0, 1, 3]) == pytest.approx(-(math.log(0.7) + math.log(0.8)) / 2)
    for error, call in ((ValueError, lambda: M.mean_squared_error(df, "a", "p", sample_weight="b")), (ValueError, lambda: M.get_scorer("magic")), (ValueError, lambda: M.check_scoring(None, M.r2_score)), (NotImplementedError, lambda: M.r2_score(df, "a", "p", multioutput="raw_values"))):
        with pytest.raises(error):
            call()


def test_splits(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), (F.col("id") % 3).alias("y"))
    train, test = splits.train_test_split(df, key="k", test_size=0.3, random_state=1)
    assert train.count() + test.count() == 1000 and 240 < test.count() < 360 and train.join(test, "k").count() == 0
    for made in (splits.KFold("k", 7), splits.KFold("k", 7, shuffle=True), splits.StratifiedKFold("k", "y", 4)):
        seen = []
        for a, b in made.split(df):
            assert a.count() + b.count() == 1000
            seen += [r["k"] for r in b.collect()]
        assert sorted(seen) == [3 * k for k in range(1000)]
    sizes = [r["count"] for r in splits.KFold("k", 7).assign(df).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [143] * 6 + [142]
    made = splits.ShuffleSplit("k", 2, 0.25, n_blocks=4)
    first, second = (made.assign(df, s).where("is_test") for s in range(2))
    assert 248 <= first.count() <= 252 and first.select("k").exceptAll(second.select("k")).count() > 0
    assert isinstance(splits.check_cv(4, "k", "y", True), splits.StratifiedKFold) and splits.check_cv(None).n_splits == 3
    assert splits.compute_n_splits(splits.LeaveOneGroupOut("y"), df) == 3 and splits.compute_n_splits(splits.PredefinedSplit("y"), df) == 3 and splits.compute_n_splits([1, 2]) == 2
    for error, call in ((ValueError, lambda: splits.train_test_split(df, key="k", test_size=5)), (NotImplementedError, lambda: splits.train_test_split(df, key="k", blockwise=False)), (TypeError, lambda: splits.train_test_split([1], key="k")), (ValueError, lambda: splits.KFold("k", 1))):
        with pytest.raises(error):
            call()


def test_positions_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else k % 5) for k in range(200)], "id long, v int")
    rows = with_position(df, "v", buckets=7).collect()
    assert sorted(r["position"] for r in rows) == list(range(200))
    order = [r["v"] for r in sorted(rows, key=lambda r: r["position"])]
    assert order == sorted(order, key=lambda v: (v is not None, v or 0))


DOCS = ["the pizza burger", "burger beer the", "coke copyright the", "pizza", "", None]


def test_vectorizers(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, text string")
    model = text.CountVectorizer()
    got = {r["id"]: dict(zip(r["counts"]["indices"], r["counts"]["values"], strict=True)) for r in model.fit_transform(df).collect()}
    names = sorted({w for d in DOCS if d for w in d.split()})
    assert model.get_feature_names_out() == names
    assert got == {k: {names.index(w): float(c) for w, c in Counter((d or "").split()).items()} for k, d in enumerate(DOCS)}
    assert set(text.CountVectorizer(min_df=2).fit(df).vocabulary_) == {"the", "pizza", "burger"}
    assert list(text.CountVectorizer(max_features=1).fit(df).vocabulary_) == ["the"]
    assert "pizza burger" in text.CountVectorizer(ngram_range=(1, 2)).fit(df).vocabulary_
    assert "the" not in text.CountVectorizer(stop_words=["the"]).fit(df).vocabulary_
    with pytest.raises(ValueError):
        text.CountVectorizer(vocabulary={"a": 1}).fit(df)
    for data, want in ((b"", 0), (b"hello", 613153351), (b"hello, world", 345750399), (b"foo", -156908512)):
        assert text.murmur3(data) == want
    hashed = {r["id"]: r["hashed"] for r in text.HashingVectorizer(n_features=1 << 16).transform(df).collect()}
    assert hashed[0]["indices"] == sorted(abs(text.murmur3(w.encode())) % (1 << 16) for w in DOCS[0].split())
    assert sum(v * v for v in hashed[0]["values"]) == pytest.approx(1) and hashed[5]["indices"] == []
    with pytest.raises(ValueError):
        text.HashingVectorizer("id").transform(df)
    pairs = spark.createDataFrame([(0, {"a": 2.0, "b": -1.0})], "id long, m map<string,double>")
    row = text.FeatureHasher("m", 1 << 10).transform(pairs).first()["hashed"]
    assert sorted(map(abs, row["values"])) == [1.0, 2.0]


@pytest.fixture(scope="module")
def classes(spark):
    df = generators.make_blobs(spark, 600, centers=[[-4.0, 0.0], [4.0, 0.0], [0.0, 6.0]])
    return df.persist()


def test_ensembles(classes):
    hard = ensemble.BlockwiseVotingClassifier(SGDClassifier(), classes=[0, 1, 2]).fit(classes, "x", "y")
    assert len(hard.estimators_) == 4 and hard.score(classes, "y") > 0.95
    soft = ensemble.BlockwiseVotingClassifier(SGDClassifier(), "soft", [0, 1, 2]).fit(classes, "x", "y")
    p = column(soft.predict_proba(classes), "probability")
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == column(soft.predict(classes), "prediction")).all()
    with pytest.raises(AttributeError):
        hard.predict_proba(classes)
    with pytest.raises(ValueError):
        ensemble.BlockwiseVotingClassifier(SGDClassifier()).fit(classes, "x", "y")
    assert ensemble.BlockwiseVotingRegressor(RidgeRegressor()).fit(classes, "x", "y").score(classes, "y") > 0


def test_incremental_and_post_fit(classes):
    model = ensemble.Incremental(SGDClassifier(), n_blocks=5).fit(classes, "x", "y", classes=[0, 1, 2])
    assert model.score(classes, "y") > 0.95
    steps = model.estimator_.t_
    assert model.partial_fit(classes, "x", "y").estimator_.t_ == 2 * steps
    x, y = column(classes, "x"), column(classes, "y")
    after = ensemble.ParallelPostFit(SGDClassifier()).fit(x, y, "x")
    assert (column(after.predict(classes), "prediction") == after.estimator_.predict(x)).all()
    assert np.allclose(np.exp(column(after.predict_log_proba(classes), "log_probability")), after.estimator_.predict_proba(x))
    with pytest.raises(AttributeError):
        after.transform(classes)
    with pytest.raises(ValueError):
        ensemble.sequential_fit(object(), classes, "x", "y", "id", 2, [0])


def test_search_policies():
    assert search.hyperband_brackets(9, 3) == [(2, 9, 1), (1, 5, 3), (0, 3, 9)]
    assert search.hyperband_brackets(27, 3) == [(3, 27, 1), (2, 12, 3), (1, 6, 9), (0, 4, 27)]
    assert search.hyperband_brackets(94, 4) == [(3, 64, 1), (2, 22, 5), (1, 8, 23), (0, 4, 94)]
    assert search.hyperband_brackets(243, 3)[0] == (5, 243, 1)
    for (r, eta), (models, calls) in {(9, 3): (17, 69), (81, 3): (143, 1581), (94, 4): (98, 1151)}.items():
        made = search.HyperbandSearchCV(None, {}, r, eta).metadata
        assert (made["n_models"], made["partial_fit_calls"]) == (models, calls)
    assert search.competition_rank([0.5, 0.9, 0.9, float("nan")]).tolist() == [3, 1, 1, 4]
    grid = list(search.ParameterGrid({"b": [1, 2], "a": [3]}))
    assert grid == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert len(list(search.ParameterSampler({"a": range(20)}, 5))) == 5


def test_grid_search(binary):
    _, _, df = binary
    made = search.GridSearchCV(linear.LogisticRegression(solver="newton", max_iter=4), {"fit_intercept": [True, False]}, cv=2, return_train_score=True).fit(df, "x", "y")
    results = made.cv_results_
    assert results["params"] == [{"fit_intercept": True}, {"fit_intercept": False}]
    for c in range(2):
        folds = [results[f"split{s}_test_score"][c] for s in range(2)]
        assert results["mean_test_score"][c] == pytest.approx(np.mean(folds))
    assert made.best_score_ == max(results["mean_test_score"]) and made.score(df, "y") > 0.7 and made.predict(df).count() == 300
    soft = search.GridSearchCV(linear.LogisticRegression(), {"solver": ["newton", "magic"], "max_iter": [3]}, cv=2, error_score=-1.0, refit=False).fit(df, "x", "y")
    assert soft.cv_results_["mean_test_score"][1] == -1
    with pytest.raises(ValueError):
        search.GridSearchCV(linear.LogisticRegression(), {"solver": ["magic"]}, cv=2).fit(df, "x", "y")


def test_adaptive_searches(classes):
    grid = {"value": [0.1 * k for k in range(9)]}
    made = search.SuccessiveHalvingSearchCV(ConstantFunction(), grid, 9, 1, aggressiveness=3, n_blocks=3).fit(classes, "x", "y")
    assert Counter(made.cv_results_["partial_fit_calls"].tolist()) == {1: 6, 3: 2, 9: 1}
    assert made.best_params_["value"] == pytest.approx(0.8) and made.metadata_ == made.metadata
    band = search.HyperbandSearchCV(ConstantFunction(), {"value": np.linspace(0, 1, 50).tolist()}, 9, 3, n_blocks=3).fit(classes, "x", "y")
    assert {k: band.metadata_[k] for k in ("n_models", "partial_fit_calls")} == {"n_models": 17, "partial_fit_calls": 69}
    steps = search.IncrementalSearchCV(LinearFunction(), {"slope": [1.0, 2.0, 3.0]}, "grid", max_iter=4, n_blocks=3).fit(classes, "x", "y")
    assert steps.best_params_["slope"] == 3.0 and set(steps.cv_results_["partial_fit_calls"]) == {4}
    flat = search.IncrementalSearchCV(ConstantFunction(), {"value": [0.5]}, "grid", patience=2, max_iter=50, n_blocks=3).fit(classes, "x", "y")
    assert max(flat.cv_results_["partial_fit_calls"]) < 6
    real = search.InverseDecaySearchCV(SGDClassifier(), {"eta0": [1e-6, 0.1, 0.5]}, "grid", max_iter=6, n_blocks=3).fit(classes, "x", "y", classes=[0, 1, 2])
    assert real.best_params_["eta0"] > 1e-6 and real.score(classes, "y") > 0.9
    with pytest.raises(ValueError):
        search.IncrementalSearchCV(ConstantFunction(), grid, max_iter=0).fit(classes, "x", "y")
    with pytest.raises(ValueError):
        search.IncrementalSearchCV(ConstantFunction(), grid, patience=1).fit(classes, "x", "y")


def test_generators(spark):
    df, coef = generators.make_regression(spark, 500, 8, 4, bias=2.0, coef=True, random_state=3)
    assert np.allclose(column(df, "x") @ coef + 2, column(df, "y")) and (coef > 0).sum() == 4
    assert np.array_equal(column(df.repartition(3), "y"), column(df, "y"))
    assert set(column(generators.make_classification(spark, 200), "y")) == {0, 1}
    assert generators.make_counts(spark, 100).where("y < 0").count() == 0
    assert generators.make_blobs(spark, 10_000).count() == 10_000
    with pytest.raises(NotImplementedError):
        generators.make_classification(spark, n_classes=3)


def test_streaming(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.array("value").alias("x"), (F.col("event_id") % 2).alias("y"), "value")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    trainer = StreamingIncremental(RidgeRegressor(), "x", "y", str(tmp_path / "model"))
    trainer.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    whole = RidgeRegressor().fit(column(events.withColumnRenamed("event_id", "id"), "x"), column(events.withColumnRenamed("event_id", "id"), "y"))
    assert np.allclose(trainer.model.coef_, whole.coef_)
    again = StreamingIncremental(RidgeRegressor(), "x", "y", str(tmp_path / "model"))
    assert again.epoch == trainer.epoch and np.allclose(again.model.coef_, whole.coef_)
    query = windowed_moments(stream, "ts", "value", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("moments").agg(F.sum("n")).first()[0] == events.count()
