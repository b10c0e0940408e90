"""Queries over metrics, distances and kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.functions import pairwise as P
from quillon.plans.tables import Query, rounded, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_Y = "SELECT l_extendedprice AS y, l_quantity * 1500.0 + l_tax * 1000.0 AS p FROM lineitem"
_PAIR = "WITH t AS (" + _Y + ") "


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0 + F.col("l_tax") * 1000.0).alias("p"))


def _add(name: str, metric, sql: str, digits: int, source=_targets, **kw: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(source(spark, sf_dir), "y", "p", compute=False, **kw).select(rounded("value", digits))

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql.format(d=digits)


_add("mean_squared_error", M.mean_squared_error, _PAIR + "SELECT round(avg((y - p) * (y - p)), {d}) AS value FROM t", 1)
_add("root_mean_squared_error", M.mean_squared_error, _PAIR + "SELECT round(sqrt(avg((y - p) * (y - p))), {d}) AS value FROM t", 4, squared=False)
_add("mean_absolute_error", M.mean_absolute_error, _PAIR + "SELECT round(avg(abs(y - p)), {d}) AS value FROM t", 4)
_add("mean_absolute_percentage_error", M.mean_absolute_percentage_error, _PAIR + "SELECT round(avg(abs(y - p) / abs(y)), {d}) AS value FROM t", 6)
_add("mean_squared_log_error", M.mean_squared_log_error, _PAIR + "SELECT round(avg(pow(ln(1 + y) - ln(1 + p), 2)), {d}) AS value FROM t", 6)
_add("r2_score", M.r2_score, _PAIR + "SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), {d}) AS value FROM t", 6)
_add("poisson_deviance", M.poisson_deviance, _PAIR + "SELECT round(2 * sum(y * ln(y / p) - (y - p)), {d}) AS value FROM t", 0)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return df.select(F.col("quality").alias("y"), (F.col("doc_id") % 2).cast("int").alias("p"), ((F.col("doc_id") % 9 + 1) / 10).alias("prob"), (F.col("doc_id") % 3 + 1).alias("w"))


_L = "WITH t AS (SELECT quality AS y, CAST(doc_id % 2 AS INTEGER) AS p, (doc_id % 9 + 1) / 10.0 AS prob, doc_id % 3 + 1 AS w FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) "
_add("accuracy_score", M.accuracy_score, _L + "SELECT round(avg(CAST(y = p AS DOUBLE)), {d}) AS value FROM t", 8, _labels)
_add("accuracy_score_weighted", M.accuracy_score, _L + "SELECT round(sum(CAST(y = p AS DOUBLE) * w) / sum(w), {d}) AS value FROM t", 8, _labels, sample_weight="w")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("y", F.col("prob").alias("p"), "w")


_add("log_loss", M.log_loss, _L + "SELECT round(avg(-ln(CASE WHEN y = 1 THEN prob ELSE 1 - prob END)), {d}) AS value FROM t", 7, _probabilities)
_add("log_loss_weighted", M.log_loss, _L + "SELECT round(sum(-ln(CASE WHEN y = 1 THEN prob ELSE 1 - prob END) * w) / sum(w), {d}) AS value FROM t", 7, _probabilities, sample_weight="w")

ANCHORS = 5


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    anchors = df.where(F.col("vec_id") < ANCHORS).orderBy("vec_id").collect()
    return df, np.array([r["embedding"] for r in anchors], dtype=float)


_CROSS = (
    f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), a AS (SELECT vec_id AS anchor, x AS y FROM e WHERE vec_id < {ANCHORS}), "
    "c AS (SELECT vec_id, anchor, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) AS dot, "
    "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS sq, len(x) AS d FROM e, a) "
)


def _long(df: DataFrame, column: str, digits: int) -> DataFrame:
    out = df.select("vec_id", F.posexplode(column).alias("anchor", "value"))
    return out.select("vec_id", F.col("anchor").cast("long").alias("anchor"), rounded("value", digits))


def _kernel(name: str, made, column: str, sql: str, digits: int = 5) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, y = _embeddings(spark, sf_dir)
        return _long(made(df, "embedding", y), column, digits)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, _CROSS + f"SELECT vec_id, anchor, round({sql}, {digits}) + 0.0 AS value FROM c"


_kernel("euclidean_distances", P.euclidean_distances, "distances", "sqrt(sq)")
_kernel("linear_kernel", P.linear_kernel, "kernel", "dot")
_kernel("rbf_kernel", P.rbf_kernel, "kernel", "exp(-sq / d)")
_kernel("polynomial_kernel", P.polynomial_kernel, "kernel", "pow(dot / d + 1, 3)")
_kernel("sigmoid_kernel", P.sigmoid_kernel, "kernel", "tanh(dot / d + 1)")


def pairwise_distances_argmin_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, y = _embeddings(spark, sf_dir)
    found = P.pairwise_distances_argmin_min(df, "embedding", y)
    return found.select("vec_id", F.col("nearest").cast("long").alias("nearest"), rounded("distance", 5))


QUERIES["pairwise_distances_argmin_min"] = pairwise_distances_argmin_min
ORACLE_SQL["pairwise_distances_argmin_min"] = _CROSS + "SELECT vec_id, arg_min(anchor, sq) AS nearest, round(sqrt(min(sq)), 5) + 0.0 AS distance FROM c GROUP BY vec_id"


def row_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", P.row_norms("embedding").alias("norm")).select("vec_id", rounded("norm", 6))


QUERIES["row_norms"] = row_norms
ORACLE_SQL["row_norms"] = "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings"
