"""Quality classifier by importance resampling of hashed n-gram models.

Words and pairs of neighbouring words are hashed to buckets.  A generative
model of target text (documents labelled as good) and one of raw text (all
documents) give each bucket a probability; a document's log weight is the sum of
log ratios of all its n-grams.  Gumbel noise is added to the log weights and the
documents with the k highest sums stay: a sample without replacement in
proportion to the importance weights.

``temper`` asks for another weighting: sums of texts with more n-grams than that
are scaled down to that many, so that length decides less.  The sample is then in
proportion to the tempered weights, not to the importance ratio.  It is off
unless it is asked for.

Counting is one pass that hands over one vector of buckets for each task;
scoring is a second pass without a shuffle.  The k-th highest sum is found by
counting digits of the sums, most significant first, so that nothing is sorted
and no task sees more than one digit's counts.

Defined results: null and empty texts have no n-grams and log weight 0; texts of
any length count whole; without a document of the target all log weights are 0;
noise depends on doc_id (null is a value like others) and seed alone, so repeated
rows have equal sums and rows that tie with the k-th all stay; null labels are no
labels; a doc_id that any label calls good is good; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded, fresh_dir, get_bytes, per_text, put_bytes, slices, table, utf8, written

BUCKETS = 10_000
SMOOTHING = 0.5
SEED = 20240101
#: Words whose hashes a task keeps.
CACHE_WORDS = 300_000
#: Sums are told apart to this many decimal digits.
DECIMALS = 9
DIGIT_BITS = 16
ENTRY_BYTES = 64
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class NGrams:
    """Bucket numbers of the words and neighbouring pairs of texts."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        grams = self

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                self[word] = number = len(self)
                data = utf8(word)
                grams.made.append(zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995))
                return number

        self.made: list[int] = []
        self.hashes = np.empty(0, dtype=np.uint64)
        self.numbers = Numbers()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all texts' n-grams, number of each text's n-grams): words, then pairs, text by text."""
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        words = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = self.numbers.__getitem__
        at = np.fromiter(map(number, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        if self.made:
            self.hashes = np.concatenate((self.hashes, np.array(self.made, dtype=np.uint64)))
            self.made = []
        own = self.hashes[at]
        single = own % np.uint64(self.buckets)
        if len(own) < 2:
            return single.astype(np.int64), sizes
        mixed = own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        pair = (mixed ^ mixed >> np.uint64(29)) % np.uint64(self.buckets)
        # A pair stands behind its first word; the last word of a text has none.
        last = np.zeros(len(own), dtype=bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        both = np.empty((len(own), 2), dtype=np.int64)
        both[:, 0], both[:-1, 1] = single, pair
        keep = np.ones((len(own), 2), dtype=bool)
        keep[last, 1] = False
        return both.reshape(-1)[keep.reshape(-1)], np.maximum(2 * sizes - 1, 0)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) summed over all of ``docs`` (text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target, seen = NGrams(buckets), np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64), False
        for part in (p for batch in batches for p in slices(batch)):
            found, sizes = grams.of(part.column(0).to_pylist())
            good = np.repeat(np.array(part.column(1).to_pylist(), dtype=bool), sizes)
            raw += np.bincount(found, minlength=buckets)
            target += np.bincount(found[good], minlength=buckets)
            seen = True
        if seen:
            full = np.flatnonzero(raw)
            yield pa.RecordBatch.from_pydict({"bucket": full.astype(np.int32), "raw": raw[full], "target": target[full]})

    counts = docs.select("text", "good").mapInArrow(run, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket; ``labels`` (doc_id, quality) mark the target by quality 1."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    good = bounded(written(good, "good"), ENTRY_BYTES)
    marked = docs.join(good, docs["doc_id"] == good["good_id"], "left").select("text", F.col("good_id").isNotNull().alias("good"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in bucket_counts(marked, buckets).collect():  # as many rows as buckets at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.any():
        return np.zeros(buckets)
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, temper: int | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every document."""
    uri = f"{fresh_dir(docs.sparkSession, 'ratios')}/ratios.pickle"
    put_bytes(uri, pickle.dumps(ratios))
    own: dict[str, tuple[NGrams, np.ndarray]] = {}

    def make(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if uri not in own:
            held = pickle.loads(get_bytes(uri))
            own[uri] = NGrams(len(held)), held
        grams, held = own[uri]
        found, sizes = grams.of(texts)
        # Each text's own sum: equal texts have equal bits, whatever stands beside them.
        sums, full = np.zeros(len(sizes)), np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(held[found], (np.cumsum(sizes) - sizes)[full])
        return sizes, sums if temper is None else sums * np.minimum(1, temper / np.maximum(sizes, 1))

    return per_text(docs, "n_grams long, log_weight double", make)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the identifier."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_highest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th highest of a long column, by counts of its digits from the highest down; None if k < 1."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if k < 1 or not ends["n"]:
        return None
    if k >= ends["n"]:
        return ends["low"]
    width = max(1, (ends["high"] - ends["low"]).bit_length())
    shift = -(-width // DIGIT_BITS) * DIGIT_BITS
    base, rest = ends["low"], values.select(F.col(column).alias("v"))
    while shift:
        shift -= DIGIT_BITS
        digit = F.shiftright(F.col("v") - F.lit(base), shift)
        inside = digit.between(0, (1 << DIGIT_BITS) - 1)
        counts = rest.where(inside).groupBy(digit.alias("digit")).count().collect()  # a row for each digit
        for row in sorted(counts, reverse=True):
            if k <= row["count"]:
                base += row["digit"] << shift
                break
            k -= row["count"]
    return base


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, temper: int | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight, perturbed, kept) of every document.

    ``share`` of the rows stays; None takes the share of quality 1 among the
    labels.  ``temper`` is described above; None takes the weights as they are.
    """
    if share is None:
        known = labels.where("quality IN (0, 1)").agg(F.avg("quality")).first()[0]
        share = 1.0 if known is None else float(known)
    scored = log_weights(docs, fit(docs, labels), temper)
    perturbed = F.round(F.col("log_weight") + gumbel(F.col("doc_id"), seed), DECIMALS)
    scored = written(scored.withColumn("perturbed", perturbed).withColumn("rank_key", F.round(F.col("perturbed") * 10**DECIMALS).cast("long")), "weights")
    least = kth_highest(scored, "rank_key", round(share * scored.count()))
    kept = F.lit(False) if least is None else F.col("rank_key") >= F.lit(least)
    return scored.select("doc_id", "n_grams", "log_weight", "perturbed", kept.alias("kept"))


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, temper: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns; a doc_id that repeats stays or goes as a whole."""
    stay = resample(docs, labels, share, seed, temper).where("kept").select(F.col("doc_id").alias("__quillon_id")).distinct()
    stay = bounded(written(stay, "stay"), ENTRY_BYTES)
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__quillon_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_resample": query}
ORACLE_SQL: dict[str, str] = {}
