"""Benchmark decontamination with an FM-index for each shard of documents.

A task cuts its documents into shards of a bounded number of words.  For each
shard it sorts the suffixes of the word sequence, keeps the Burrows-Wheeler
transform as a wavelet matrix, and samples suffix positions.  Test phrases are
searched backwards by wavelet ranks, all at once; occurrences are located by
walking to the next sampled position; the spans that they cover are merged.

There is no shuffle: a document's result needs its own shard and the phrases.
Executors cut the benchmark into slices of bounded size (a phrase that very many
items share goes to several slices, a very long item too) and write them to the
shared folder; tasks stream them.  The driver holds the paths of the slices only,
and nothing that grows with the benchmark is broadcast.

Defined results: a null or wordless document has no words, no hits and no
items; a null or wordless item has no windows; equal items all count; a null
item_id is an item named by the empty string; texts and items of any length are
read whole; rows are returned once each, repeated ones too; other columns,
whatever their names, are ignored (and pass ``decontaminate`` untouched); an empty
table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh_dir, get_bytes, put_bytes, slices, table, tidied, utf8
from quillon.llm.wavelet import BitVector, WaveletMatrix

WINDOW = 8
MIN_ITEMS = 2
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 300_000
#: Pairs of a phrase and an item in a slice.
SLICE_PAIRS = 200_000
#: Distance of sampled text positions within a document.
SAMPLE = 8
#: Occurrences located at once.
LOCATE_ROWS = 200_000

_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of the text with A-Z lower-cased."""
    return utf8(text).lower().translate(_KEEP).split() if text else []


class _Codes(dict):
    """Words to symbols from 1; 0 separates documents."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) + 1
        return code


def suffix_array(symbols: np.ndarray, separators: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes in order; each separator is smaller than all words and differs from the others.

    Keys of as many symbols as fit 63 bits are sorted first, then ranks are
    doubled for the suffixes that are still tied.
    """
    n, ends = len(symbols), len(separators)
    rank = symbols.astype(np.int64) + (ends - 1)
    rank[separators] = np.arange(ends)
    width = max(1, int(ends + sigma).bit_length())
    depth = max(1, 63 // width)
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= width
        if k < n:
            key[: n - k] |= rank[k:]
    order = np.argsort(key)
    tied_order, tied_key = order, key[order]
    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)  # places in the suffix array of what is being sorted
    while len(at):
        first = np.ones(len(at), dtype=bool)
        first[1:] = tied_key[1:] != tied_key[:-1]
        leader = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        rank[tied_order] = at[leader]
        single = first.copy()
        single[:-1] &= first[1:]
        order[at] = tied_order
        rest = ~single
        at, tied_order = at[rest], tied_order[rest]
        if not len(at):
            break
        # A tied suffix has no separator among its first ``depth`` symbols: what follows is in range.
        tied_key = rank[tied_order] * n + rank[tied_order + depth]
        again = np.argsort(tied_key)
        tied_order, tied_key = tied_order[again], tied_key[again]
        depth *= 2
    return order


class FMIndex:
    """Index of documents given as symbol arrays (from 1)."""

    def __init__(self, docs: list[np.ndarray], sigma: int, sample: int = SAMPLE):
        lengths = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        n = int(lengths.sum())
        text = np.zeros(n, dtype=np.uint32)
        for start, doc in zip(self.starts, docs, strict=True):
            text[start : start + len(doc)] = doc
        separators = self.starts + lengths - 1
        order = suffix_array(text, separators, sigma)
        self.levels = max(1, int(sigma).bit_length())
        self.matrix = WaveletMatrix.build(text[order - 1], self.levels)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))[:-1]
        every = np.arange(sigma + 1)
        self.home = self.matrix.follow(every, np.zeros_like(every))
        inside = np.arange(n) - np.repeat(self.starts, lengths)
        kept = (inside % sample == 0)[order]
        self.sampled, self.positions = BitVector.of(kept), order[kept]
        self.n = n

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.follow(symbol, at) - self.home[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of phrases of equal length (rows of symbols), last symbol first."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            low[alive] = self._step(symbol, low[alive])
            high[alive] = self._step(symbol, high[alive])
            empty = low[alive] >= high[alive]
            high[alive[empty]] = low[alive[empty]]
            alive = alive[~empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows.  A document's start is sampled, so no walk leaves it."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), dtype=np.int64)
        waiting = np.arange(len(rows))
        while len(waiting):
            done = self.sampled.get(at).astype(bool)
            out[waiting[done]] = self.positions[self.sampled.rank(at[done])] + steps
            waiting, at = waiting[~done], at[~done]
            symbol, behind = self.matrix.access(at)
            at = self.first[symbol] + behind - self.home[symbol]
            steps += 1
        return out


@dataclass
class Phrases:
    """A slice: phrases of each length as rows of numbers of its own words, and the names of the items that hold them."""

    words: list[bytes]
    groups: list[tuple[np.ndarray, list[list[str]]]]


def _windows(item: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    if item:
        for k in range(max(1, len(item) - WINDOW + 1)):
            yield tuple(item[k : k + WINDOW])


def _packed(phrases: dict[tuple[bytes, ...], set[str]]) -> Phrases:
    codes, by_length = _Codes(), defaultdict(list)
    for phrase, items in phrases.items():
        by_length[len(phrase)].append(([codes[w] for w in phrase], sorted(items)))
    return Phrases(list(codes), [(np.array([p for p, _ in group], dtype=np.int64) - 1, [i for _, i in group]) for group in by_length.values()])


def write_phrases(benchmark: DataFrame) -> list[str]:
    """Slices of phrases in the shared folder, cut by executors; their paths."""
    root = fresh_dir(benchmark.sparkSession, "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        pairs = 0

        def flush() -> pa.RecordBatch:
            # A name of its own for each attempt: the driver reads those of the attempts that count.
            path = f"{root}/{uuid.uuid4().hex}.pickle"
            put_bytes(path, pickle.dumps(_packed(phrases)))
            phrases.clear()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for part in (p for batch in batches for p in slices(batch)):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for phrase in _windows(words(text)):
                    items = phrases[phrase]
                    pairs += name not in items
                    items.add(name)
                    if pairs >= SLICE_PAIRS:
                        yield flush()
                        pairs = 0
        if phrases:
            yield flush()

    name = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    return sorted(r["path"] for r in benchmark.select(name, "text").mapInArrow(run, "path string").collect())


def hits(docs: list[list[bytes]], slices: Iterator[Phrases]) -> list[tuple[np.ndarray, set[str]]]:
    """For each document of a shard: mask of hit words, and items with occurring windows."""
    codes = _Codes()
    arrays = [np.fromiter(map(codes.__getitem__, d), dtype=np.uint32, count=len(d)) for d in docs]
    found: list[set[str]] = [set() for _ in docs]
    if not codes:
        return [(np.zeros(0, dtype=bool), s) for s in found]
    index = FMIndex(arrays, len(codes))
    cover = np.zeros(index.n + 1, dtype=np.int64)
    for phrases in slices:
        # The slice's words in the shard's symbols; phrases with a word that the shard lacks can't occur.
        symbols = np.fromiter((codes.get(w, 0) for w in phrases.words), dtype=np.int64, count=len(phrases.words))
        for rows_of, items in phrases.groups:
            group = symbols[rows_of]
            known = np.flatnonzero((group > 0).all(axis=1))
            if not len(known):
                continue
            group, length = group[known], group.shape[1]
            low, high = index.search(group)
            number = high - low
            which = np.repeat(np.arange(len(group)), number)
            rows = np.repeat(low, number) + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            for at in range(0, len(rows), LOCATE_ROWS):
                places = index.locate(rows[at : at + LOCATE_ROWS])
                np.add.at(cover, places, 1)
                np.add.at(cover, places + length, -1)
                owner = np.searchsorted(index.starts, places, side="right") - 1
                pairs = np.unique(owner * len(group) + which[at : at + LOCATE_ROWS])
                for doc, g in zip((pairs // len(group)).tolist(), (pairs % len(group)).tolist(), strict=True):
                    found[doc].update(items[known[g]])
    hit = np.cumsum(cover[:-1]) > 0
    return [(hit[s : s + len(d)], f) for s, d, f in zip(index.starts, docs, found, strict=True)]


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged removal spans (code points): from the first to the last word of each run of hit words."""
    out: list[tuple[int, int]] = []
    previous = False
    for m, h in zip(_WORD.finditer(text.translate(_ASCII_LOWER)), hit.tolist(), strict=True):
        if h:
            out.append((out.pop()[0], m.end()) if previous else m.span())
        previous = h
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Rows of a shard with their words; cuts at SHARD_WORDS."""
    rows: list[pa.RecordBatch] = []
    docs: list[list[bytes]] = []
    known: dict[bytes, bytes] = {}  # one object for each distinct word of a shard
    total = 0
    for batch in (p for b in tidied(batches) for p in slices(b)):
        start = 0
        for k, text in enumerate(batch.column("text").to_pylist()):
            docs.append([known.setdefault(w, w) for w in words(text)])
            total += len(docs[-1]) + 1
            if total >= SHARD_WORDS:
                rows.append(batch.slice(start, k + 1 - start))
                yield pa.Table.from_batches(rows), docs
                rows, docs, known, total, start = [], [], {}, 0, k + 1
        if start < len(batch):
            rows.append(batch.slice(start))
    if docs:
        yield pa.Table.from_batches(rows), docs


def _searched(batches: Iterator[pa.RecordBatch], paths: list[str]) -> Iterator[tuple[pa.Table, list]]:
    kept = pickle.loads(get_bytes(paths[0])) if len(paths) == 1 else None
    for rows, docs in _shards(batches):
        slices = iter([kept]) if kept is not None else (pickle.loads(get_bytes(p)) for p in paths)
        yield rows, hits(docs, slices)


def _applied(docs: DataFrame, benchmark: DataFrame, schema: str, make: Callable[[pa.Table, list], list]) -> DataFrame:
    """doc_id and the columns that ``make`` gives for each shard."""
    paths = write_phrases(benchmark)
    names = [f.strip().split(" ")[0] for f in re.sub(r"<.*?>", "", schema).split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _searched(batches, paths):
            columns = [rows.column("doc_id").combine_chunks(), *make(rows, found)]
            yield from pa.table(columns, ["doc_id", *names]).to_batches()

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, {schema}")


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document."""

    def make(rows: pa.Table, found: list) -> list:
        cut = [
            [{"start": a, "end": b} for a, b in spans(t, h)] if h.any() else []
            for t, (h, _) in zip(rows.column("text").to_pylist(), found, strict=True)
        ]
        return [
            pa.array([len(h) for h, _ in found], pa.int64()),
            pa.array([int(h.sum()) for h, _ in found], pa.int64()),
            pa.array([sorted(s) for _, s in found], pa.list_(pa.string())),
            pa.array(cut, _SPAN),
        ]

    schema = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    return _applied(docs, benchmark, schema, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Documents with windows of fewer than ``min_items`` items, without their hit spans.

    Contaminated documents go whole.  From the others the merged spans are cut
    (and n_chars, where there is such a column, counts what is left).
    """
    paths = write_phrases(benchmark)

    def cut(text: str, hit: np.ndarray) -> str:
        at, parts = 0, []
        for start, end in spans(text, hit):
            parts.append(text[at:start])
            at = end
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _searched(batches, paths):
            if any(h.any() for h, _ in found):
                texts = rows.column("text").to_pylist()
                new = {k: cut(texts[k], h) for k, (h, _) in enumerate(found) if h.any()}
                change = {"text": new, "n_chars": {k: len(t) for k, t in new.items()}}
                for name, values in change.items():
                    at = rows.schema.get_field_index(name)
                    if at >= 0:
                        old = rows.column(at).to_pylist()
                        array = pa.array([values.get(k, v) for k, v in enumerate(old)], rows.schema.field(at).type)
                        rows = rows.set_column(at, rows.schema.field(at), array)
            yield from rows.filter(pa.array([len(s) < min_items for _, s in found], pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(_: pa.Table, found: list) -> list:
        names = [",".join(sorted(s)) for _, s in found]
        return [
            pa.array([len(h) for h, _ in found], pa.int64()),
            pa.array([int(h.sum()) for h, _ in found], pa.int64()),
            pa.array([len(s) for _, s in found], pa.int64()),
            pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names], pa.string()),
            pa.array([len(s) >= MIN_ITEMS for _, s in found], pa.bool_()),
        ]

    schema = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _applied(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), schema, make)


QUERIES = {"op4_decontaminate": query}

ORACLE_SQL = {
    "op4_decontaminate": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
    SELECT item_id, least(len(w), 8) AS size, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda k: w[k:k + 7])) AS phrase
    FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM p),
o AS (
    SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size
), h AS (
    SELECT o.doc_id, o.k, o.size, p.item_id FROM o JOIN p ON p.size = o.size AND p.phrase = o.w[o.k:o.k + o.size - 1]
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM h) GROUP BY 1
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS names FROM h GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
