"""Text vectorisers: tokens by a regular expression on the JVM, sparse rows (size, indices, values)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.base import Estimator

TOKEN = r"(?U)\b\w\w+\b"
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
#: Terms that a vocabulary may have on the driver.
MAX_TERMS = 5_000_000


def tokens(text: Column, pattern: str = TOKEN, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = ()) -> Column:
    """Array of terms; null texts have none."""
    text = F.coalesce(F.lower(text) if lowercase else text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    low, high = ngram_range
    if (low, high) == (1, 1):
        return words

    def grams(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.array_join(F.slice(words, k, n), " "))

    return F.concat(*map(grams, range(low, high + 1)))


class CountVectorizer(Estimator):
    """Term counts over a sorted vocabulary.

    Document frequencies are of the whole frame (with ``min_df``, ``max_df`` as
    numbers or shares).  Counts are made within each row, against a broadcast
    vocabulary of at most ``MAX_TERMS`` terms; ``key`` may be null or repeat.
    """

    def __init__(self, column: str = "text", key: str = "id", lowercase: bool = True, token_pattern: str = TOKEN, ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = (), min_df: float = 1, max_df: float = 1.0, max_features: int | None = None, vocabulary: Mapping[str, int] | Sequence[str] | None = None, binary: bool = False):
        self.column, self.key, self.lowercase, self.token_pattern, self.ngram_range = column, key, lowercase, token_pattern, ngram_range
        self.stop_words, self.min_df, self.max_df, self.max_features, self.vocabulary, self.binary = stop_words, min_df, max_df, max_features, vocabulary, binary

    def _terms(self) -> Column:
        return tokens(F.col(f"`{self.column}`"), self.token_pattern, self.lowercase, self.ngram_range, self.stop_words)

    def fit(self, df: DataFrame) -> CountVectorizer:
        if self.vocabulary is not None:
            known = self.vocabulary if isinstance(self.vocabulary, Mapping) else {t: k for k, t in enumerate(self.vocabulary)}
            if sorted(known.values()) != list(range(len(known))):
                raise ValueError("vocabulary indices must be 0..n-1")
            self.vocabulary_ = dict(known)
            return self
        rows = df.select(F.explode(F.array_distinct(self._terms()) if not self.max_features else self._terms()).alias("term"), F.lit(1).alias("one"))
        if self.max_features:
            rows = df.select(F.monotonically_increasing_id().alias("row"), F.explode(self._terms()).alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("one"))
        counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("one").alias("tf"))
        n = df.count() if isinstance(self.min_df, float) or isinstance(self.max_df, float) else 0
        low = self.min_df * n if isinstance(self.min_df, float) else self.min_df
        high = self.max_df * n if isinstance(self.max_df, float) else self.max_df
        counts = counts.where((F.col("df") >= low) & (F.col("df") <= high))
        if self.max_features:
            counts = counts.orderBy(F.desc("tf"), "term").limit(self.max_features)
        found = counts.select("term").limit(MAX_TERMS + 1).collect()
        if not found:
            raise ValueError("empty vocabulary; perhaps the documents only contain stop words")
        if len(found) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms: set min_df, max_df or max_features")
        self.vocabulary_ = {t: k for k, t in enumerate(sorted(r["term"] for r in found))}
        return self

    def term_counts(self, df: DataFrame) -> DataFrame:
        """(key, term index, count) of every row in long form, unknown terms left out."""
        pair = F.explode(F.arrays_zip("__counts.indices", "__counts.values")).alias("p")
        rows = self.transform(df, "__counts").select(f"`{self.key}`", pair)
        return rows.select(f"`{self.key}`", F.col("p.indices").alias("term_index"), F.col("p.values").cast("long").alias("count"))

    def transform(self, df: DataFrame, output: str = "counts") -> DataFrame:
        """(key, sparse counts) for every row; a row without known terms is empty."""
        self.check_fitted("vocabulary_")
        known, binary, most = df.sparkSession.sparkContext.broadcast(self.vocabulary_), self.binary, SLICE_TERMS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = known.value
            for batch in _slices(batches, 1, most):
                names, term, row = _flat_terms(batch.column(1))
                index = np.fromiter((vocabulary.get(t, -1) for t in names.to_pylist()), dtype=np.int64, count=len(names))[term]
                row, index = row[index >= 0], index[index >= 0]
                at, counts = np.unique(row * len(vocabulary) + index, return_counts=True)
                values = np.ones(len(at)) if binary else counts.astype(float)
                made = _sparse(batch.num_rows, len(vocabulary), at // len(vocabulary), at % len(vocabulary), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), made], [self_key, output])

        self_key, kind = self.key, dict(df.dtypes)[self.key]
        return df.select(F.col(f"`{self.key}`"), self._terms().alias("__terms")).mapInArrow(run, f"`{self.key}` {kind}, `{output}` {SPARSE}")

    def fit_transform(self, df: DataFrame, output: str = "counts") -> DataFrame:
        return self.fit(df).transform(df, output)

    def get_feature_names_out(self) -> list[str]:
        return sorted(self.vocabulary_, key=self.vocabulary_.get)


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, signed."""
    mask, h = 0xFFFFFFFF, seed

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for k in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[k : k + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


#: Bytes up to which terms are hashed side by side.
LONG_TERM = 256


def murmur3_each(terms: pa.Array) -> np.ndarray:
    """``murmur3`` of each string of an array, as 64-bit integers."""
    terms = terms.cast(pa.large_binary())
    if not len(terms):
        return np.zeros(0, dtype=np.int64)
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")  # long ones first, so that those with a further block are a head
    order, apart = order[size[order] <= LONG_TERM], order[size[order] > LONG_TERM]
    start, length = ends[:-1][order], size[order]
    out = np.zeros(len(size), dtype=np.int64)
    for k in apart.tolist():
        out[k] = murmur3(data[ends[k] : ends[k + 1]].tobytes())

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    h = np.zeros(len(order), dtype=np.uint32)
    for block in range(int(length[0]) // 4 if len(length) else 0):
        n = int(np.searchsorted(-length, -4 * (block + 1), side="right"))
        at = start[:n] + 4 * block
        word = sum(data[at + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4))
        head = h[:n] ^ mixed(word)
        h[:n] = (head << np.uint32(13) | head >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    tail, rest = np.zeros(len(order), dtype=np.uint32), length % 4
    for j in range(3):
        has = np.flatnonzero(rest > j)
        tail[has] |= data[start[has] + length[has] // 4 * 4 + j].astype(np.uint32) << np.uint32(8 * j)
    h ^= mixed(tail)  # nothing where there is no tail
    h ^= length.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    out[order] = h.view(np.int32)
    return out


#: Terms of the rows that are worked on at once; a row with more is alone.
SLICE_TERMS = 1 << 18


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows whose lists in ``column`` have at most ``most`` values together."""
    for batch in batches:
        ends = np.cumsum(np.nan_to_num(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at, before = stop, int(ends[stop - 1])


def _flat_terms(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each occurrence's term, its row) of a column of arrays."""
    terms = lists.flatten().dictionary_encode()
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return terms.dictionary, terms.indices.to_numpy(), np.repeat(np.arange(len(lists)), sizes)


def _sparse(rows: int, size: int, row: np.ndarray, index: np.ndarray, values: np.ndarray) -> pa.StructArray:
    """Sparse rows of entries that are sorted by row and index."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), pa.int32())
    parts = [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((index, pa.int32()), (values, pa.float64()))]
    return pa.StructArray.from_arrays([pa.array(np.full(rows, size), pa.int32()), *parts], ["size", "indices", "values"])


class _Hasher(Estimator):
    def _hashed(self, df: DataFrame, terms: Column, amounts: Column | None, output: str, norm: str | None) -> DataFrame:
        """Arrays of names, and of their values if those aren't all 1."""
        size, signed, binary, most = self.n_features, self.alternate_sign, getattr(self, "binary", False), SLICE_TERMS
        kept, weighted = [c for c in df.columns if c != output], amounts is not None
        extra = [terms.alias("__terms"), *([] if amounts is None else [amounts.alias("__amounts")])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, len(kept), most):
                names, term, row = _flat_terms(batch.column(len(kept)))
                place = murmur3_each(names)
                at, sign = np.abs(place) % size, np.where(signed & (place < 0), -1, 1)
                amount = sign[term].astype(float)
                if weighted:
                    amount = amount * batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False)
                cell, entry = np.unique(row * size + at[term], return_inverse=True)
                sums = np.bincount(entry, amount, len(cell))
                cell, sums = cell[sums != 0], sums[sums != 0]
                row, index = cell // size, cell % size
                if binary:
                    sums = np.ones(len(sums))
                if norm:
                    total = np.bincount(row, np.abs(sums) if norm == "l1" else sums**2, batch.num_rows)
                    sums = sums / (total if norm == "l1" else np.sqrt(total))[row]
                made = _sparse(batch.num_rows, size, row, index, sums)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], [*kept, output])

        schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != output], f"`{output}` {SPARSE}"])
        return df.select(*[f"`{c}`" for c in kept], *extra).mapInArrow(run, schema)


class HashingVectorizer(_Hasher):
    """Stateless term hashing with alternating signs, normalised rows."""

    def __init__(self, column: str = "text", n_features: int = 1 << 20, lowercase: bool = True, token_pattern: str = TOKEN, ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = (), norm: str | None = "l2", alternate_sign: bool = True, binary: bool = False):
        self.column, self.n_features, self.lowercase, self.token_pattern, self.ngram_range = column, n_features, lowercase, token_pattern, ngram_range
        self.stop_words, self.norm, self.alternate_sign, self.binary = stop_words, norm, alternate_sign, binary

    def fit(self, df: DataFrame | None = None) -> HashingVectorizer:
        return self

    def transform(self, df: DataFrame, output: str = "hashed") -> DataFrame:
        if dict(df.dtypes).get(self.column) != "string":
            raise ValueError(f"{self.column} is not a column of texts")
        terms = tokens(F.col(f"`{self.column}`"), self.token_pattern, self.lowercase, self.ngram_range, self.stop_words)
        return self._hashed(df, terms, None, output, self.norm)

    fit_transform = transform


class FeatureHasher(_Hasher):
    """Hashes a column of maps (dict), of (name, value) structs (pair) or of names (string)."""

    def __init__(self, column: str, n_features: int = 1 << 20, input_type: str = "dict", alternate_sign: bool = True):
        if input_type not in ("dict", "pair", "string"):
            raise ValueError(f"input_type must be 'dict', 'pair' or 'string', got {input_type!r}")
        self.column, self.n_features, self.input_type, self.alternate_sign = column, n_features, input_type, alternate_sign

    def fit(self, df: DataFrame | None = None) -> FeatureHasher:
        return self

    def transform(self, df: DataFrame, output: str = "hashed") -> DataFrame:
        column = F.col(f"`{self.column}`")
        if self.input_type == "string":
            return self._hashed(df, F.coalesce(column, F.array().cast("array<string>")), None, output, None)
        if self.input_type == "dict":
            column = F.map_entries(column)
        entries = F.coalesce(column.cast("array<struct<name:string,value:double>>"), F.array().cast("array<struct<name:string,value:double>>"))
        return self._hashed(df, F.transform(entries, lambda e: e["name"]), F.transform(entries, lambda e: e["value"]), output, None)

    fit_transform = transform
