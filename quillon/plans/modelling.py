"""Queries over models, clustering, decomposition, text, splits, ensembles and searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import cluster, decomposition, ensemble, linear, search, splits, text
from quillon.operators.learners import RidgeRegressor, SGDClassifier
from quillon.plans.tables import Query, rounded, rows, table
from quillon.sources import generators

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: Places of the vectors in ``embeddings``, from 1.
DIMS = range(1, 65)
#: Rows that the single-machine model of ``parallel_post_fit`` is trained on; it predicts all rows.
TRAIN_ROWS = 200


# Linear models and naive Bayes


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = linear.LinearRegression(solver="newton").fit(df, ["l_quantity"], "l_extendedprice")
    return rows(spark, [(round(model.coef_[0], 4), round(model.intercept_, 3))], "slope double, intercept double")


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir).withColumn("y", (F.col("label") % 2).cast("int"))
    model = linear.LogisticRegression(solver="newton").fit(df, "x", "y")
    return model.predict_proba(model.predict(df)).select("vec_id", "prediction", F.round(F.col("probability")[1], 6).alias("probability"))


@query()
def poisson_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = generators.make_counts(spark, 2000, 5, 3, random_state=3)
    model = linear.PoissonRegression(solver="lbfgs", C=1e6).fit(df, "x", "y")
    return model.predict(df).select("id", "y", F.round("prediction", 6).alias("prediction"))


_NB = ", ".join(f"avg(CAST(embedding[{k}] AS DOUBLE)) AS m{k}, var_pop(CAST(embedding[{k}] AS DOUBLE)) AS v{k}" for k in DIMS)


@query(
    f"WITH s AS (SELECT label, count(*) AS n, {_NB} FROM embeddings GROUP BY label) SELECT label, n, "
    + ", ".join(f"round(m{k}, 6) + 0.0 AS m{k}, round(v{k}, 6) AS v{k}" for k in DIMS)
    + " FROM s"
)
def gaussian_nb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = linear.GaussianNB().fit(_embeddings(spark, sf_dir), "x", "label")
    names = [n for k in DIMS for n in (f"m{k}", f"v{k}")]
    out = [(c, n, *[float(v) for pair in zip(a, b, strict=True) for v in pair]) for c, n, a, b in zip(m.classes_, m.counts_, m.theta_, m.sigma_, strict=True)]
    return rows(spark, out, ", ".join(["label int", "n long", *[f"{n} double" for n in names]])).select("label", "n", *[rounded(n, 6) for n in names])


@query(
    f"WITH s AS (SELECT label AS c, count(*) / (SELECT count(*) FROM embeddings) AS prior, {_NB} FROM embeddings GROUP BY label), j AS (SELECT vec_id, c, ln(prior) - 0.5 * ("
    + " + ".join(f"ln(2 * pi() * v{k}) + pow(CAST(embedding[{k}] AS DOUBLE) - m{k}, 2) / v{k}" for k in DIMS)
    + ") AS jll FROM embeddings, s) SELECT vec_id, arg_max(c, jll) AS prediction FROM j GROUP BY vec_id"
)
def gaussian_nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    return linear.GaussianNB().fit(df, "x", "label").predict(df).select("vec_id", "prediction")


# Clustering


@query(
    "WITH e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS x{k}" for k in DIMS) + " FROM embeddings), "
    "a AS (SELECT vec_id AS c, " + ", ".join(f"x{k} AS a{k}" for k in DIMS) + " FROM e WHERE vec_id < 3), "
    "d AS (SELECT vec_id, arg_min(c, " + " + ".join(f"(x{k} - a{k}) * (x{k} - a{k})" for k in DIMS) + ") AS c FROM e, a GROUP BY vec_id) "
    "SELECT c AS cluster, count(*) AS n, " + ", ".join(f"round(avg(x{k}), 6) + 0.0 AS x{k}" for k in DIMS) + " FROM e JOIN d USING (vec_id) GROUP BY c"
)
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    start = np.array([r["x"] for r in df.where("vec_id < 3").orderBy("vec_id").collect()])
    model = cluster.KMeans(3, init=start, max_iter=1, tol=0).fit(df, "x")
    first = cluster.KMeans(3, init=start)
    first.cluster_centers_, first.features_ = start, "x"
    sizes = {r["prediction"]: r["count"] for r in first.predict(df).groupBy("prediction").count().collect()}
    out = [(k, sizes.get(k, 0), *map(float, c)) for k, c in enumerate(model.cluster_centers_)]
    return rows(spark, out, "cluster long, n long, " + ", ".join(f"x{k} double" for k in DIMS)).select("cluster", "n", *[rounded(f"x{k}", 6) for k in DIMS])


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cluster.KMeans(8, random_state=1, key="vec_id").fit_predict(df, "embedding").select("vec_id", "prediction")


@query()
def spectral_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cluster.SpectralClustering(4, gamma=None, n_components=50, key="vec_id").fit_predict(df, "embedding").select("vec_id", "prediction")


# Decomposition


_COV = (
    "WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) "
    "SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS value FROM e a JOIN e b USING (vec_id) GROUP BY a.k, b.k"
)


@query(_COV)
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, outer = decomposition.moments(_embeddings(spark, sf_dir), "x")
    return rows(spark, [(i, j, outer[i - 1, j - 1] / (n - 1)) for i in DIMS for j in DIMS], "i int, j int, value double").select("i", "j", rounded("value", 6))


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return decomposition.PCA(8).fit_transform(df, "embedding").select("vec_id", "pca")


@query()
def incremental_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").orderBy("vec_id")
    return decomposition.IncrementalPCA(4, batch_size=128).fit(df, "embedding").transform(df).select("vec_id", "pca")


@query()
def truncated_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return decomposition.TruncatedSVD(5).fit_transform(df, "embedding").select("vec_id", "svd")


# Text

ASCII = "[a-z0-9_]{2,}"
_TERMS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{ASCII}')) AS term FROM documents"


def _vectorizer() -> text.CountVectorizer:
    return text.CountVectorizer("text", "doc_id", token_pattern=ASCII, min_df=20)


@query(f"WITH t AS (SELECT term FROM (SELECT DISTINCT doc_id, term FROM ({_TERMS})) GROUP BY term HAVING count(*) >= 20) SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM t")
def count_vectorizer_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectorizer().fit(table(spark, sf_dir, "documents")).vocabulary_
    return rows(spark, list(found.items()), "term string, place long")


@query(
    f"WITH r AS ({_TERMS}), t AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM (SELECT DISTINCT doc_id, term FROM r) GROUP BY term HAVING count(*) >= 20), "
    "c AS (SELECT doc_id, place, count(*) AS n FROM r JOIN t USING (term) GROUP BY 1, 2) "
    "SELECT d.doc_id, count(place) AS terms, CAST(coalesce(sum(n), 0) AS DOUBLE) AS total, CAST(coalesce(sum(n * (place + 1)), 0) AS DOUBLE) AS mark FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1"
)
def count_vectorizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _vectorizer().fit_transform(docs)
    total = F.aggregate("counts.values", F.lit(0.0), lambda s, x: s + x)
    mark = F.aggregate(F.zip_with("counts.indices", "counts.values", lambda k, v: (k + 1) * v), F.lit(0.0), lambda s, x: s + x)
    return out.select("doc_id", F.size("counts.indices").cast("long").alias("terms"), total.alias("total"), mark.alias("mark"))


@query()
def hashing_vectorizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.HashingVectorizer(n_features=1 << 12).transform(docs).select("doc_id", "hashed")


@query()
def feature_hasher(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.col("p_brand"), F.lit(1.0)).alias("m"))
    return text.FeatureHasher("m", 64).transform(df).select("p_partkey", "hashed")


# Splits


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.KFold("o_orderkey", 7).assign(table(spark, sf_dir, "orders").select("o_orderkey"))


@query("SELECT doc_id, CAST(ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.StratifiedKFold("doc_id", "quality", 5).assign(table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "fold")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions.positions import with_position

    return with_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query()
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splits.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), key="o_orderkey", test_size=0.25, random_state=7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query()
def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ShuffleSplit("o_orderkey", test_size=0.2, random_state=3).assign(table(spark, sf_dir, "orders").select("o_orderkey"), 0)


# Ensembles, incremental training, searches


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return df, sorted(r[0] for r in df.select("label").distinct().collect())


@query()
def voting_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _classes(spark, sf_dir)
    return ensemble.BlockwiseVotingClassifier(SGDClassifier(), "hard", classes, "vec_id").fit(df, "embedding", "label").predict(df).select("vec_id", "prediction")


@query()
def voting_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _classes(spark, sf_dir)
    return ensemble.BlockwiseVotingRegressor(RidgeRegressor(), "vec_id").fit(df, "embedding", "label").predict(df).select("vec_id", "prediction")


@query()
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _classes(spark, sf_dir)
    return ensemble.Incremental(SGDClassifier(), "vec_id", 4).fit(df, "embedding", "label", classes=classes).predict(df).select("vec_id", "prediction")


@query()
def parallel_post_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _classes(spark, sf_dir)
    sample = df.orderBy("vec_id").limit(TRAIN_ROWS).collect()
    model = ensemble.ParallelPostFit(SGDClassifier()).fit(np.array([r["embedding"] for r in sample]), np.array([r["label"] for r in sample]), "embedding")
    return model.predict_proba(df).select("vec_id", "probability")


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir).withColumn("y", (F.col("label") % 2).cast("int"))
    found = search.GridSearchCV(linear.LogisticRegression(solver="lbfgs", max_iter=15), {"C": [0.01, 1.0, 100.0]}, cv=3, key="vec_id").fit(df, "x", "y").cv_results_
    out = [(float(p["C"]), round(float(m), 6), int(r)) for p, m, r in zip(found["params"], found["mean_test_score"], found["rank_test_score"], strict=True)]
    return rows(spark, out, "c double, mean_test_score double, rank_test_score long")


@query()
def successive_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _classes(spark, sf_dir)
    made = search.SuccessiveHalvingSearchCV(SGDClassifier(), {"alpha": [1e-5, 1e-3, 1e-1], "eta0": [0.01, 0.1, 1.0]}, 9, 1, aggressiveness=3, key="vec_id", n_blocks=4).fit(df, "embedding", "label", classes=classes)
    out = [(int(m), int(c), int(r)) for m, c, r in zip(made.cv_results_["model_id"], made.cv_results_["partial_fit_calls"], made.cv_results_["rank_test_score"], strict=True)]
    return rows(spark, out, "model_id long, partial_fit_calls long, rank_test_score long")


@query("SELECT * FROM (VALUES (4, 81, 1), (3, 34, 3), (2, 15, 9), (1, 8, 27), (0, 5, 81)) t(bracket, n_models, calls)")
def hyperband_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, search.hyperband_brackets(81, 3), "bracket int, n_models int, calls int")


@query(
    "SELECT p_brand, round(s, 4) AS score, rank() OVER (ORDER BY s DESC) AS place FROM (SELECT p_brand, round(avg(p_retailprice), 2) AS s FROM part GROUP BY 1)"
)
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("score")).collect()
    places = search.competition_rank([r["score"] for r in found])
    return rows(spark, [(r["p_brand"], round(r["score"], 4), p) for r, p in zip(found, places, strict=True)], "p_brand string, score double, place long")


# Sources and streams


@query()
def make_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.make_blobs(spark, 10_000, 4, random_state=1)


@query()
def make_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.make_regression(spark, 10_000, 20, noise=1.0, random_state=1)


@query()
def make_classification_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.make_classification_df(spark, 10_000, n_features=5, random_state=1)
