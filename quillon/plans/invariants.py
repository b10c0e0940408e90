"""Queries over iterative learners whose results SQL can tell: what must hold of any right model.

A rotation keeps distances, a model without penalty and with an intercept is right
on average, a split deals every row once, a schedule fixes the number of calls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import pairwise
from quillon.operators import cluster, decomposition, ensemble, linear, scalers, search, splits, text
from quillon.operators.learners import SGDClassifier
from quillon.plans.tables import Query, rounded, rows, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIMS = 64


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _energy(column: str) -> F.Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)


_LONG = "SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings"
_CENTRED = f"WITH e AS ({_LONG}), m AS (SELECT k, avg(x) AS mean FROM e GROUP BY k) SELECT vec_id, round(sum((x - mean) * (x - mean)), 4) AS energy FROM e JOIN m USING (k) GROUP BY vec_id"


@query(_CENTRED)
def pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components keep each row's distance from the mean."""
    out = decomposition.PCA(DIMS).fit_transform(_vectors(spark, sf_dir), "x")
    return out.select("vec_id", _energy("pca").alias("energy")).select("vec_id", rounded("energy", 4))


@query(_CENTRED)
def incremental_pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decomposition.IncrementalPCA(DIMS, batch_size=128).fit(_vectors(spark, sf_dir), "x").transform(_vectors(spark, sf_dir))
    return out.select("vec_id", _energy("pca").alias("energy")).select("vec_id", rounded("energy", 4))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{k}] AS DOUBLE), 5) + 0.0 AS x{k}" for k in (1, 2, 64)) + " FROM embeddings")
def pca_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all components give back is the row itself."""
    model = decomposition.PCA(DIMS, whiten=True).fit(_vectors(spark, sf_dir), "x")
    out = model.inverse_transform(model.transform(_vectors(spark, sf_dir)))
    return out.select("vec_id", *[F.col("restored")[k - 1].alias(f"x{k}") for k in (1, 2, 64)]).select("vec_id", *[rounded(f"x{k}", 5) for k in (1, 2, 64)])


@query(f"SELECT vec_id, round(sum(x * x), 4) AS energy FROM ({_LONG}) GROUP BY vec_id")
def truncated_svd_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of zeros beside, so that all but one component hold everything."""
    df = _vectors(spark, sf_dir).withColumn("x", F.concat("x", F.array(F.lit(0.0))))
    out = decomposition.TruncatedSVD(DIMS).fit_transform(df, "x")
    return out.select("vec_id", _energy("svd").alias("energy")).select("vec_id", rounded("energy", 4))


@query("SELECT round(avg(label % 2), 6) AS share, true AS calibrated FROM embeddings")
def logistic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a penalty the mean probability is the share of ones."""
    df = _vectors(spark, sf_dir).select("x", (F.col("label") % 2).cast("int").alias("y"))
    model = linear.LogisticRegression(solver="newton", tol=1e-8, max_iter=25).fit(df.select(F.slice("x", 1, 2).alias("x"), "y"), "x", "y")
    out = model.predict_proba(df.select(F.slice("x", 1, 2).alias("x"), "y"))
    gap = F.abs(F.avg(F.col("probability")[1]) - F.avg("y"))
    return out.agg(F.avg("y").alias("share"), (gap < 1e-6).alias("calibrated")).select(rounded("share", 6), "calibrated")


@query("SELECT round(avg(l_linenumber), 6) AS mean, true AS calibrated FROM lineitem")
def poisson_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", F.col("l_linenumber").cast("double").alias("y"))
    model = linear.PoissonRegression(solver="newton", tol=1e-8, max_iter=25).fit(df, ["q", "l_discount"], "y")
    gap = F.abs(F.avg("prediction") - F.avg("y"))
    return model.predict(df).agg(F.avg("y").alias("mean"), (gap < 1e-6).alias("calibrated")).select(rounded("mean", 6), "calibrated")


_NB = ", ".join(f"avg(CAST(embedding[{k}] AS DOUBLE)) AS m{k}, var_pop(CAST(embedding[{k}] AS DOUBLE)) AS v{k}" for k in range(1, DIMS + 1))


@query(
    f"WITH s AS (SELECT label AS c, count(*) / (SELECT count(*) FROM embeddings) AS prior, {_NB} FROM embeddings GROUP BY label), j AS (SELECT vec_id, c, ln(prior) - 0.5 * ("
    + " + ".join(f"ln(2 * pi() * v{k}) + pow(CAST(embedding[{k}] AS DOUBLE) - m{k}, 2) / v{k}" for k in range(1, DIMS + 1))
    + ") AS jll FROM embeddings, s), t AS (SELECT vec_id, max(jll) AS top FROM j GROUP BY vec_id) SELECT vec_id, round(1 / sum(exp(jll - top)), 5) AS best FROM j JOIN t USING (vec_id) GROUP BY vec_id"
)
def gaussian_nb_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    out = linear.GaussianNB().fit(df, "x", "label").predict_proba(df)
    return out.select("vec_id", F.array_max("probability").alias("best")).select("vec_id", rounded("best", 5))


@query(f"WITH e AS ({_LONG}), m AS (SELECT k, avg(x) AS mean FROM e GROUP BY k) SELECT round(sum((x - mean) * (x - mean)), 3) AS inertia FROM e JOIN m USING (k)")
def kmeans_single_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One center is the mean; the inertia is the spread around it."""
    model = cluster.KMeans(1, random_state=2, key="vec_id").fit(_vectors(spark, sf_dir), "x")
    return rows(spark, [(float(model.inertia_),)], "inertia double").select(rounded("inertia", 3))


@query("SELECT p_partkey, round((row_number() OVER (ORDER BY p_partkey) - 1) / (count(*) OVER () - 1), 6) AS p FROM part")
def quantile_transformer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a quantile for each row, distinct values map to their ranks."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("p"))
    made = scalers.QuantileTransformer(n_quantiles=df.count(), columns=["p"]).fit(df)
    return made.transform(df).select("p_partkey", rounded("p", 6))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS DOUBLE) AS total FROM documents")
def hashing_vectorizer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without signs and norm the values add up to the number of terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = text.HashingVectorizer(n_features=1 << 10, token_pattern="[a-z0-9_]{2,}", norm=None, alternate_sign=False).transform(docs)
    return out.select("doc_id", F.aggregate("hashed.values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT p_partkey, CAST(p_size + 1 AS DOUBLE) AS total FROM part")
def feature_hasher_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.col("p_brand"), F.lit(1.0)).alias("m"))
    out = text.FeatureHasher("m", 64, alternate_sign=False).transform(df)
    return out.select("p_partkey", F.aggregate("hashed.values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS parts FROM orders")
def train_test_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is in one part, and in one only."""
    train, test = splits.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), key="o_orderkey", test_size=0.25, random_state=7)
    return train.unionByName(test).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS parts, true AS near FROM orders")
def shuffle_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is dealt once, and the share of test rows is within one row of each block of what was asked."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    made = splits.ShuffleSplit("o_orderkey", test_size=0.2, random_state=3, n_blocks=16).assign(orders, 0)
    n, test = made.agg(F.count(F.lit(1)), F.sum(F.col("is_test").cast("long"))).first()
    return made.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("parts")).withColumn("near", F.lit(abs(test - 0.2 * n) <= 16))


@query(
    "WITH e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS x{k}" for k in range(1, DIMS + 1)) + " FROM embeddings) SELECT e.vec_id, "
    + ", ".join(f"round(sum(CASE WHEN a.vec_id = {j} THEN " + " + ".join(f"e.x{k} * a.x{k}" for k in range(1, DIMS + 1)) + f" END), 5) + 0.0 AS k{j}" for j in (0, 1))
    + " FROM e, e a WHERE a.vec_id < 2 GROUP BY e.vec_id"
)
def pairwise_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    two = np.array([r["x"] for r in df.where("vec_id < 2").orderBy("vec_id").collect()])
    out = pairwise.pairwise_kernels(df, "x", two, metric="linear")
    return out.select("vec_id", *[F.col("kernel")[j].alias(f"k{j}") for j in (0, 1)]).select("vec_id", rounded("k0", 5), rounded("k1", 5))


# Searches: candidates, splits and calls follow from the parameters.


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return df, sorted(r[0] for r in df.select("label").distinct().collect())


@query("SELECT CAST(4 AS BIGINT) AS candidates, CAST(3 AS BIGINT) AS splits, CAST(1 AS BIGINT) AS best_rank, true AS probable")
def randomized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).select("vec_id", F.slice("x", 1, 4).alias("x"), (F.col("label") % 2).cast("int").alias("y"))
    found = search.RandomizedSearchCV(linear.LogisticRegression(solver="newton", max_iter=8), {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "tol": [1e-3, 1e-4]}, n_iter=4, cv=3, key="vec_id", refit=False).fit(df, "x", "y")
    made = found.cv_results_
    between = all(0 <= s <= 1 for s in made["mean_test_score"])
    return rows(spark, [(len(made["params"]), found.n_splits_, int(min(made["rank_test_score"])), bool(between))], "candidates long, splits long, best_rank long, probable boolean")


@query("SELECT * FROM (VALUES (1, 6), (3, 2), (9, 1)) t(calls, models)")
def successive_halving_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _blocks(spark, sf_dir)
    made = search.SuccessiveHalvingSearchCV(SGDClassifier(), {"alpha": [1e-5, 1e-3, 1e-1], "eta0": [0.01, 0.1, 1.0]}, 9, 1, aggressiveness=3, key="vec_id", n_blocks=4).fit(df, "embedding", "label", classes=classes)
    calls = [int(c) for c in made.cv_results_["partial_fit_calls"]]
    return rows(spark, [(c, calls.count(c)) for c in sorted(set(calls))], "calls int, models int")


@query("SELECT CAST(4 AS BIGINT) AS models, CAST(3 AS BIGINT) AS most_calls, CAST(3 AS BIGINT) AS least_calls")
def incremental_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _blocks(spark, sf_dir)
    made = search.IncrementalSearchCV(SGDClassifier(), {"alpha": [1e-5, 1e-3], "eta0": [0.01, 0.1]}, 4, max_iter=3, key="vec_id", n_blocks=4).fit(df, "embedding", "label", classes=classes)
    calls = [int(c) for c in made.cv_results_["partial_fit_calls"]]
    return rows(spark, [(len(calls), max(calls), min(calls))], "models long, most_calls long, least_calls long")


@query("SELECT CAST(4 AS BIGINT) AS models, CAST(4 AS BIGINT) AS most_calls")
def inverse_decay_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, classes = _blocks(spark, sf_dir)
    made = search.InverseDecaySearchCV(SGDClassifier(), {"alpha": [1e-5, 1e-3], "eta0": [0.01, 0.1]}, 4, max_iter=4, decay_rate=1.0, key="vec_id", n_blocks=4).fit(df, "embedding", "label", classes=classes)
    calls = [int(c) for c in made.cv_results_["partial_fit_calls"]]
    return rows(spark, [(len(calls), max(calls))], "models long, most_calls long")


@query("SELECT CAST(17 AS BIGINT) AS models, CAST(9 AS BIGINT) AS most_calls")
def hyperband_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets of 9, 5 and 3 models."""
    df, classes = _blocks(spark, sf_dir)
    made = search.HyperbandSearchCV(SGDClassifier(), {"alpha": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1], "eta0": [0.01, 0.1, 0.5, 1.0]}, max_iter=9, aggressiveness=3, key="vec_id", n_blocks=4).fit(df, "embedding", "label", classes=classes)
    calls = [int(c) for c in made.cv_results_["partial_fit_calls"]]
    return rows(spark, [(len(calls), max(calls))], "models long, most_calls long")


@query("SELECT vec_id, true AS within FROM embeddings")
def voting_regressor_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the blocks' predictions lies between the smallest and the largest of them."""
    from quillon.operators.learners import RidgeRegressor

    df, _ = _blocks(spark, sf_dir)
    model = ensemble.BlockwiseVotingRegressor(RidgeRegressor(), "vec_id").fit(df, "embedding", "label")
    models = model.estimators_
    own = ensemble.apply_model(model.predict(df), "embedding", lambda x: np.column_stack([m.predict(x) for m in models]), "each", kind="array<double>")
    return own.select("vec_id", F.col("prediction").between(F.array_min("each") - 1e-9, F.array_max("each") + 1e-9).alias("within"))
