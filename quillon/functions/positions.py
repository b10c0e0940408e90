"""Global row positions without a single-task sort.

Rows are dealt to ranges of the key by its approximate quantiles; a range's first
position is the sum of the counts before it (one number for each range), and a
window numbers the rows inside a range.  Ranges depend on key values alone, so a
recomputed task gives the same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = "__quillon_bucket"


def bucket(df: DataFrame, key: str, buckets: int) -> Column:
    cuts = sorted(set(df.stat.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(f"`{key}`")))


def with_position(df: DataFrame, key: str, within: str | None = None, name: str = "position", buckets: int | None = None) -> DataFrame:
    """``df`` with the 0-based position in ``key`` order, counted for each value of ``within`` apart.

    Null keys come first; equal keys are numbered in any order.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [within] if within else []
    rows = df.withColumn(BUCKET, F.coalesce(bucket(df, key, buckets), F.lit(-1)))
    counts = rows.groupBy(*group, BUCKET).count()
    # One row for each bucket (and group): small whatever the number of rows.
    before = F.coalesce(F.sum("count").over(W.partitionBy(*[F.col(f"`{c}`") for c in group] or [F.lit(0)]).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(f"`{c}`").alias(f"__g_{c}") for c in group], F.col(BUCKET).alias("__b"), before.alias("__before"))
    condition = F.col(BUCKET) == F.col("__b")
    for c in group:
        condition = condition & F.col(f"`{c}`").eqNullSafe(F.col(f"__g_{c}"))
    inside = F.row_number().over(W.partitionBy(*[f"`{c}`" for c in group], BUCKET).orderBy(F.col(f"`{key}`").asc_nulls_first())) - 1
    numbered = rows.withColumn(name, inside.cast("long"))
    numbered = numbered.join(F.broadcast(offsets), condition)  # buckets times groups rows
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col("__before")).cast("long").alias(name))


def fold_of(position: Column, n: Column | int, k: int) -> Column:
    """Contiguous folds over 0-based positions: sizes n // k, the first n % k one larger."""
    n = F.lit(n) if isinstance(n, int) else n
    size, rest = F.floor(n / k), n % k
    edge = rest * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(rest + F.floor((position - edge) / F.greatest(size, F.lit(1)))).cast("int")
