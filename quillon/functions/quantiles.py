"""Exact percentiles of columns of any number of distinct values.

While the columns have few distinct values, as a sketch of them tells, and few
percentiles are asked for, one aggregation holds them.  Beyond that no task holds a column: values are counted
before the shuffle (copies collapse to one row), dealt to ranges of their column
and summed by range; then the ranges that hold a wanted rank are sorted.  Both ways
give the same numbers.  Ranges depend on values alone, so a recomputed task deals
alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distinct values of all columns together that one aggregation may hold.
HELD_VALUES = 1_000_000
#: Percentiles that one aggregation is asked for; its time grows faster than their number.
HELD_POINTS = 1_000


def distinct_sizes(df: DataFrame, columns: Sequence[Column]) -> int:
    """Approximate number of distinct values of all columns together."""
    row = df.agg(*[F.approx_count_distinct(c).alias(str(k)) for k, c in enumerate(columns)]).first()
    return sum(row)


def exact_percentiles(df: DataFrame, columns: Sequence[Column], at: Sequence[float], distinct: int | None = None) -> list[list[float] | None]:
    """For each column its percentiles (0 to 1), linear between neighbours; None for a column without values.

    ``distinct`` is the number of distinct values of all columns, counted if None.
    """
    if distinct is None:
        distinct = distinct_sizes(df, columns)
    if distinct <= HELD_VALUES and len(at) <= HELD_POINTS:
        points = F.split(F.lit(",".join(repr(float(p)) for p in at)), ",").cast("array<double>")  # one literal, however many
        return list(df.agg(*[F.percentile(c.cast("double"), points).alias(str(k)) for k, c in enumerate(columns)]).first())
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), c.cast("double").alias("v")) for k, c in enumerate(columns)])).alias("c")
    counts = df.select(cells).select("c.k", "c.v").where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        return _ranked(counts, len(columns), at)
    finally:
        counts.unpersist()


def _ranked(counts: DataFrame, width: int, at: Sequence[float]) -> list[list[float] | None]:
    """Percentiles from (column, value, count)."""
    buckets = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = [k / buckets for k in range(1, buckets)]
    found = counts.groupBy("k").agg(F.percentile_approx("v", points, 10 * buckets).alias("cuts")).collect()  # a row for each column
    cuts = {r["k"]: np.unique(r["cuts"]) for r in found}

    def dealt(wanted: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, v, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                place = k * buckets
                for own in np.unique(k):
                    place[k == own] += np.searchsorted(cuts[own], v[k == own], side="right")
                keep = np.ones(len(k), bool) if wanted is None else np.isin(place, wanted)
                yield pa.RecordBatch.from_pydict({"place": place[keep], "v": v[keep], "n": n[keep]})

        return counts.select("k", "v", "n").mapInArrow(run, "place long, v double, n long")

    sums = np.zeros(width * buckets, dtype=np.int64)
    for row in dealt(None).groupBy("place").agg(F.sum("n").alias("n")).collect():  # columns times ranges
        sums[row["place"]] = row["n"]
    ends = sums.reshape(width, buckets).cumsum(1)
    before = (ends - sums.reshape(width, buckets)).ravel()
    rank = (ends[:, -1:] - 1) * np.asarray(at, dtype=float)  # columns by percentiles
    ranks = [np.unique([np.floor(r), np.ceil(r)]).astype(np.int64) for r in rank]
    wanted = np.unique(np.concatenate([[], *[k * buckets + np.searchsorted(ends[k], ranks[k], side="right") for k in range(width) if ends[k, -1]]])).astype(np.int64)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, v, n, through = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            last, k = before[place] + through, place // buckets
            keep = np.zeros(len(k), bool)
            for own in np.unique(k):
                m = k == own
                keep[m] = np.searchsorted(ranks[own], (last - n)[m]) < np.searchsorted(ranks[own], last[m])
            yield pa.RecordBatch.from_pydict({"k": k[keep], "last": last[keep], "v": v[keep]})

    running = F.sum("n").over(W.partitionBy("place").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    rows = dealt(wanted).select("place", "v", "n", running.alias("through")).mapInArrow(hit, "k long, last long, v double")
    hits: dict[int, list[tuple[int, float]]] = {}
    for row in rows.collect():  # two for each column and percentile at most
        hits.setdefault(row["k"], []).append((row["last"], row["v"]))
    out: list[list[float] | None] = []
    for k in range(width):
        if k not in hits:
            out.append(None)
            continue
        last, values = map(np.array, zip(*sorted(hits[k]), strict=True))
        low, high = (values[np.searchsorted(last, f(rank[k]), side="right")] for f in (np.floor, np.ceil))
        with np.errstate(invalid="ignore"):
            mixed = (np.ceil(rank[k]) - rank[k]) * low + (rank[k] - np.floor(rank[k])) * high
        out.append(np.where(low == high, low, mixed).tolist())
    return out
