"""Queries over scalers, imputers and encoders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import encoders as E
from quillon.operators import scalers as S
from quillon.plans.tables import Query, rounded, rows, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SCALED = "WITH p AS (SELECT " + ", ".join(f"avg({c}) m{k}, sqrt(var_pop({c})) s{k}" for k, c in enumerate(MEASURES)) + " FROM lineitem) "


@query(
    _SCALED
    + "SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"round(avg(({c} - m{k}) / s{k}), 6) + 0.0 AS {c}" for k, c in enumerate(MEASURES))
    + " FROM lineitem, p GROUP BY 1"
)
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *MEASURES)
    out = S.StandardScaler(MEASURES).fit(df).transform(df)
    out = out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in MEASURES])
    return out.select("l_returnflag", "n", *[rounded(c, 6) for c in MEASURES])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean_, round(var_pop({c}), 3) AS var_, round(sqrt(var_pop({c})), 4) AS scale_ FROM lineitem" for c in MEASURES
    )
)
def standard_scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = S.StandardScaler(MEASURES).fit(table(spark, sf_dir, "lineitem").select(*MEASURES)).params_df(spark)
    return fitted.select("feature", rounded("mean_", 4), rounded("var_", 3), rounded("scale_", 4))


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in MEASURES) + " FROM lineitem GROUP BY 1")
def standard_scaler_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *MEASURES)
    scaler = S.StandardScaler(MEASURES).fit(df)
    out = scaler.inverse_transform(scaler.transform(df)).groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in MEASURES])
    return out.select("l_returnflag", *[rounded(c, 4) for c in MEASURES])


@query("SELECT o_orderkey, round((o_totalprice - low) / (high - low) * 3 - 1, 7) + 0.0 AS o_totalprice FROM orders, (SELECT min(o_totalprice) low, max(o_totalprice) high FROM orders)")
def minmax_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.MinMaxScaler((-1, 2), ["o_totalprice"]).fit(df).transform(df).select("o_orderkey", rounded("o_totalprice", 7))


@query(
    "SELECT p_partkey, round((p_retailprice - q[2]) / (q[3] - q[1]), 7) + 0.0 AS p_retailprice, round((p_size - r[2]) / (r[3] - r[1]), 7) + 0.0 AS p_size "
    "FROM part, (SELECT quantile_cont(p_retailprice, [0.1, 0.5, 0.9]) q, quantile_cont(CAST(p_size AS DOUBLE), [0.1, 0.5, 0.9]) r FROM part)"
)
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    out = S.RobustScaler(quantile_range=(10, 90), columns=["p_retailprice", "p_size"]).fit(df).transform(df)
    return out.select("p_partkey", rounded("p_retailprice", 7), rounded("p_size", 7))


@query()
def quantile_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return S.QuantileTransformer(100, "normal", ["p_retailprice", "p_size"]).fit(df).transform(df)


@query(
    "SELECT l_returnflag, count(*) AS bias, round(sum(l_quantity), 3) AS a, round(sum(l_tax), 3) AS b, round(sum(l_quantity * l_quantity), 3) AS aa, "
    "round(sum(l_quantity * l_tax), 3) AS ab, round(sum(l_tax * l_tax), 3) AS bb FROM lineitem GROUP BY 1"
)
def polynomial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    out = S.PolynomialFeatures(2, columns=["q", "t"], preserve=True).fit(df).transform(df)
    names = {"a": "q", "b": "t", "aa": "q^2", "ab": "q t", "bb": "t^2"}
    sums = [F.sum(f"`{c}`").alias(n) for n, c in names.items()]
    return out.groupBy("l_returnflag").agg(F.sum("1").cast("long").alias("bias"), *sums).select("l_returnflag", "bias", *[rounded(n, 3) for n in names])


@query("SELECT p_brand, round(sum(p_retailprice * 2), 4) AS doubled FROM part GROUP BY 1")
def block_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    def double(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(p_retailprice=batch["p_retailprice"] * 2)

    out = S.BlockTransformer(double).transform(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"))
    return out.groupBy("p_brand").agg(F.sum("p_retailprice").alias("doubled")).select("p_brand", rounded("doubled", 4))


def _imputed(strategy: str, statistic: str, column: str = "value", digits: int = 6):
    sql = (
        f"WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN {column} END AS v FROM events), s AS ({statistic}) "
        f"SELECT event_id, {'round(coalesce(v, s), 6)' if digits else 'coalesce(v, s)'} AS {column} FROM e, s"
    )

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = F.when(F.col("event_id") % 10 != 0, F.col(column)).alias(column)
        df = table(spark, sf_dir, "events").select("event_id", held)
        out = S.SimpleImputer(strategy, -1.0 if strategy == "constant" else None, [column]).fit(df).transform(df)
        return out.select("event_id", rounded(column, digits) if digits else column)

    run.__name__ = f"imputer_{strategy}"
    query(sql)(run)


_imputed("mean", "SELECT avg(v) AS s FROM e")
_imputed("median", "SELECT median(v) AS s FROM e")
_imputed("constant", "SELECT -1.0 AS s")
_imputed("most_frequent", "SELECT v AS s FROM e WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1", "event_type", 0)


@query("SELECT row_number() OVER (ORDER BY p_brand) - 1 AS code, p_brand AS category FROM (SELECT DISTINCT p_brand FROM part)")
def categorizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.Categorizer(columns=["p_brand"]).fit(table(spark, sf_dir, "part")).categories_["p_brand"]
    return rows(spark, list(enumerate(found)), "code long, category string")


@query("WITH c AS (SELECT DISTINCT c_mktsegment s FROM customer) SELECT c_custkey, s AS segment, CAST(c_mktsegment = s AS INTEGER) AS hot FROM customer, c")
def dummy_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    encoder = E.DummyEncoder().fit(df)
    out = encoder.transform(df)
    pairs = F.array(*[F.struct(F.lit(v).alias("segment"), F.col(f"`c_mktsegment_{v}`").alias("hot")) for v in encoder.categories_["c_mktsegment"]])
    return out.select("c_custkey", F.explode(pairs).alias("p")).select("c_custkey", "p.segment", "p.hot")


@query(
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority, "
    "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus FROM orders"
)
def ordinal_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return E.OrdinalEncoder().fit(df).transform(df)


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def ordinal_encoder_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    encoder = E.OrdinalEncoder().fit(df)
    return encoder.inverse_transform(encoder.transform(df))


@query(
    "WITH b AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS i, dense_rank() OVER (ORDER BY p_type) - 1 AS j FROM part), n AS (SELECT count(DISTINCT p_brand) AS k FROM part) "
    "SELECT p_partkey, i AS first_index, j + k AS second_index FROM b, n"
)
def onehot_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    out = E.OneHotEncoder(["p_brand", "p_type"]).fit(df).transform(df)
    return out.select("p_partkey", *[F.col("onehot.indices")[k].cast("long").alias(n) for k, n in enumerate(("first_index", "second_index"))])


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM customer")
def label_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.LabelEncoder("c_mktsegment").fit_transform(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query(
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment, round((c_acctbal - m) / s, 7) + 0.0 AS c_acctbal "
    "FROM customer, (SELECT avg(c_acctbal) m, sqrt(var_pop(c_acctbal)) s FROM customer)"
)
def column_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    made = E.make_column_transformer((E.OrdinalEncoder(), ["c_mktsegment"]), (S.StandardScaler(), ["c_acctbal"]), ("passthrough", ["c_custkey"]))
    return made.fit(df).transform(df).select("c_custkey", "c_mktsegment", rounded("c_acctbal", 7))


@query(
    "WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / (SELECT sqrt(var_pop(c_acctbal)) FROM customer) AS v FROM customer) "
    "SELECT c_custkey, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 7) + 0.0 AS c_acctbal FROM z"
)
def pipeline_of_scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    made = E.make_pipeline(S.StandardScaler(["c_acctbal"]), S.MinMaxScaler(columns=["c_acctbal"]))
    return made.fit_transform(df).select("c_custkey", rounded("c_acctbal", 7))


