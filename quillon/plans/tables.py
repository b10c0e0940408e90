from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(name: str, digits: int) -> Column:
    """Rounded double; a negative zero becomes zero."""
    return (F.round(F.col(f"`{name}`").cast("double"), digits) + F.lit(0.0)).alias(name)


def rows(spark: SparkSession, values: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in values], schema)
