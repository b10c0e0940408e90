"""Token ids in wavelet-matrix files, one shard each.

A file holds the ids of consecutive documents in ascending doc_id order: the
shard's ids are renumbered densely, and each bit of the numbers is one plane of
a wavelet matrix, with counts of ones for rank and select.  So one file gives
access to any token, counts of an id in any range, and its occurrences, as well
as plain sequential decoding.

Layout: magic, length of the header, JSON header, sections.  The header names
each section with its length, its stored length and CRC-32; sections are
zstd-compressed where that makes them smaller.  Sections: ``alphabet`` (uint32),
``plane0``... (packed bits, highest first), ``ranks0``... (ones before each
block of 512 bits, uint32), ``doc_ids`` (int64), ``missing`` (null doc_ids) and
``lengths`` (uint32).

Writing sorts documents by range partitioning on doc_id, the text's hash and the
row's place, so that the rows of one identifier can fill many partitions; a task
rolls its files at a bounded number of tokens and knows its files' places within
its partition, so that the driver adds up one number for each partition.

Defined results: null and empty texts have the end id only; null doc_ids come
first; repeated doc_ids keep one row each, equal texts side by side; a text of any
length stays in one file; other columns, whatever their names, are ignored; an
empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh_dir, get_bytes, put_bytes, slices, table, tasks_for, utf8, written
from quillon.llm.wavelet import BitVector, WaveletMatrix

MAGIC = b"QWMX0001"
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Tokens of a file; a file ends with the document that reaches it.
FILE_TOKENS = 1_000_000
#: Words whose ids a task keeps.
CACHE_WORDS = 500_000
#: Bytes of texts encoded at once.
ENCODE_BYTES = 12 << 20
#: Words that the library encodes at once, and words of a line of them.
ENCODE_WORDS, LINE_WORDS = 10_000, 100
#: Letters that normalisation turns into as many letters: one match of the splitting pattern.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = frozenset(c for c in map(chr, range(0x61, 0x100)) if _PLAIN.fullmatch(c))
_TAIL = frozenset(".,;:!?")
BLOCK_WORDS = 8
MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()), ("path", pa.string())])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The tokenizers library over cached words.

    ASCII white space always ends a match of this vocabulary's splitting pattern
    and takes part in no token, so ids of a text are those of its words in turn.
    So it is between a letter and punctuation that follows.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        encoder = self

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                if word[-1:] in _TAIL and (stem := word.rstrip("".join(_TAIL)))[-1:] in _LETTERS:
                    # Letters and what follows them are encoded apart, and the letters are often known already.
                    encoder.joined.append((self[stem], self[word[len(stem) :]], len(self)))
                    self[word] = number = len(self)
                    return number
                self[word] = number = len(self)
                encoder.pending.append(word)
                encoder.pending_numbers.append(number)
                return number

        self.pending: list[str] = []
        self.pending_numbers: list[int] = []
        self.joined: list[tuple[int, int, int]] = []
        self.numbers = Numbers()
        self.flat = np.empty(0, dtype=np.uint32)
        self.at, self.size, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the words used again, at most half of the bound; uses age by half."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE_WORDS // 2:
            kept = np.sort(np.argpartition(-self.uses, CACHE_WORDS // 2)[: CACHE_WORDS // 2])
        words, flat, at, size, uses = list(self.numbers), self.flat, self.at[kept], self.size[kept], self.uses[kept]
        self.clear()
        self.numbers.update((words[k], n) for n, k in enumerate(kept.tolist()))
        self.flat, self.at, self.size, self.uses = _gather(flat, at, size), np.cumsum(size) - size, size, uses // 2

    def _encode_pending(self) -> None:
        """Encode new words: plain ones in lines, in which pieces that end a word tell them apart, others one by one."""
        count = len(self.numbers)
        if count == len(self.at):
            return
        grown = np.zeros(count - len(self.at), dtype=np.int64)
        self.at, self.size = np.concatenate((self.at, grown)), np.concatenate((self.size, grown))
        flat, end = [self.flat], len(self.flat)
        for start in range(0, len(self.pending), ENCODE_WORDS):
            part = self.pending[start : start + ENCODE_WORDS]
            numbers = np.array(self.pending_numbers[start : start + ENCODE_WORDS], dtype=np.int64)
            plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in part), dtype=bool, count=len(part))
            words = [part[k] for k in np.flatnonzero(plain).tolist()]
            lines = [" ".join(words[k : k + LINE_WORDS]) for k in range(0, len(words), LINE_WORDS)]
            ids = self._ids(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))
            stops = np.flatnonzero(self.ends[ids]) + 1
            odd = self.tokenizer.encode_batch_fast([part[k] for k in np.flatnonzero(~plain).tolist()], add_special_tokens=False)
            sizes = np.concatenate((np.diff(stops, prepend=0), np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))))
            numbers = np.concatenate((numbers[plain], numbers[~plain]))
            self.size[numbers], self.at[numbers] = sizes, end + np.cumsum(sizes) - sizes
            flat += [ids, self._ids(odd)]
            end += int(sizes.sum())
        self.flat = np.concatenate(flat)
        if self.joined:
            stem, tail, number = np.array(self.joined, dtype=np.int64).T
            both = np.column_stack((stem, tail)).reshape(-1)
            sizes = self.size[stem] + self.size[tail]
            self.size[number], self.at[number] = sizes, len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate((self.flat, _gather(self.flat, self.at[both], self.size[both])))
        self.pending, self.pending_numbers, self.joined = [], [], []

    @staticmethod
    def _ids(made: list) -> np.ndarray:
        return np.fromiter(chain.from_iterable(e.ids for e in made), dtype=np.uint32)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with end ids, ids of each text)."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # ASCII is lower-cased as the library would do, unless a special piece's name may be meant.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        own = np.fromiter(map(self.numbers.__getitem__, names), dtype=np.int64, count=len(names))
        at = own[words.indices.to_numpy()]
        self._encode_pending()
        uses = np.bincount(at, minlength=len(self.numbers))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        # One more entry, of the end id alone, follows each text's words.
        ends = np.cumsum(sizes)
        at = np.insert(at, ends, len(self.at))
        lengths = np.append(self.size, 1)[at]
        ids = _gather(np.append(self.flat, np.uint32(END_ID)), np.append(self.at, len(self.flat))[at], lengths)
        stops = np.cumsum(lengths)[ends + np.arange(len(ends))]
        return ids, np.diff(stops, prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder, with its cache, for each worker process."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _gather(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``sizes`` values that begin at ``at``, one behind the other."""
    return flat[np.arange(int(sizes.sum())) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)]


class TokenFile:
    """One shard, read from its bytes."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", payload, 8)
        self.header = json.loads(payload[12 : 12 + size])
        self._at, at = {}, 12 + size
        for name, length, stored, crc in self.header["sections"]:
            self._at[name] = (at, length, stored, crc)
            at += stored
        self._payload, self.n = payload, self.header["tokens"]
        self._matrix: WaveletMatrix | None = None

    def section(self, name: str, dtype: str) -> np.ndarray:
        at, length, stored, crc = self._at[name]
        data = self._payload[at : at + stored]
        if zlib.crc32(data) != crc:
            raise ValueError(f"section {name} is damaged")
        return np.frombuffer(pa.decompress(data, decompressed_size=length, codec="zstd", asbytes=True) if stored < length else data, dtype=dtype)

    @property
    def matrix(self) -> WaveletMatrix:
        if self._matrix is None:
            planes = [BitVector(self.section(f"plane{k}", "<u8"), self.n) for k in range(self.header["levels"])]
            for k, plane in enumerate(planes):
                if not np.array_equal(plane.before[:-1:BLOCK_WORDS], self.section(f"ranks{k}", "<u4")):
                    raise ValueError(f"rank counts of plane {k} are damaged")
            self._matrix = WaveletMatrix(planes, self.n)
        return self._matrix

    def tokens(self) -> np.ndarray:
        return self.section("alphabet", "<u4")[self.matrix.decode(np.uint16 if self.header["levels"] <= 16 else np.uint32)]

    def access(self, at: np.ndarray) -> np.ndarray:
        return self.section("alphabet", "<u4")[self.matrix.access(np.asarray(at))[0]]

    def _symbol(self, token: int) -> int | None:
        alphabet = self.section("alphabet", "<u4")
        k = int(np.searchsorted(alphabet, token))
        return k if k < len(alphabet) and alphabet[k] == token else None

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        symbol = self._symbol(token)
        return 0 if symbol is None else self.matrix.count(symbol, low, self.n if high is None else high)

    def occurrences(self, token: int) -> np.ndarray:
        symbol = self._symbol(token)
        return np.empty(0, dtype=np.int64) if symbol is None else self.matrix.occurrences(symbol)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        missing = self.section("missing", "u1").astype(bool)
        ids = self.section("doc_ids", "<i8")
        return [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)], self.section("lengths", "<u4")


def token_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """Bytes of one shard."""
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    dense = (np.cumsum(present) - 1).astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[ids]
    levels = max(1, (max(1, len(alphabet)) - 1).bit_length())
    matrix = WaveletMatrix.build(dense, levels)
    parts = {"alphabet": alphabet}
    for k, plane in enumerate(matrix.planes):
        parts[f"plane{k}"] = plane.words
        parts[f"ranks{k}"] = plane.before[:-1:BLOCK_WORDS].astype("<u4")
    parts["doc_ids"] = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    parts["missing"] = np.array([i is None for i in doc_ids], dtype="u1")
    parts["lengths"] = lengths.astype("<u4")
    sections, body = [], []
    for name, values in parts.items():
        data = values.tobytes()
        packed = pa.compress(data, codec="zstd", asbytes=True) if data else data
        stored = packed if len(packed) < len(data) else data
        sections.append((name, len(data), len(stored), zlib.crc32(stored)))
        body.append(stored)
    header = json.dumps({"tokens": len(ids), "levels": levels, "documents": len(doc_ids), "sections": sections}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


def write_tokens(docs: DataFrame, root: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files under ``root``; returns the manifest.

    Manifest: part (partition in doc_id order), file (within it), start (tokens
    before it in its partition), tokens, path.
    """
    spark = docs.sparkSession
    root = root or fresh_dir(spark, "tokens")
    parts = tasks_for(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        file = start = held = 0
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal file, start, held, kept
            ids, names, lengths = (list(x) for x in zip(*kept, strict=True))
            uri = f"{root}/part-{part:06d}-{file:06d}.qwm"
            tokens = np.concatenate(ids)
            put_bytes(uri, token_file(tokens, [i for n in names for i in n], np.concatenate(lengths)))
            row = {"part": part, "file": file, "start": start, "tokens": len(tokens), "path": uri}
            row = pa.RecordBatch.from_pylist([row], MANIFEST)
            file, start, held, kept = file + 1, start + len(tokens), 0, []
            return row

        for batch in (p for b in batches for p in slices(b, ENCODE_BYTES)):
            ids, lengths = encoder.encode(batch.column(1))
            kept.append((ids, batch.column(0).to_pylist(), lengths))
            held += len(ids)
            if held >= FILE_TOKENS:
                yield flush()
        if kept:
            yield flush()

    # Texts and places split the rows of one identifier, however many, over several tasks.
    order = ["doc_id", "hash", "place"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(run, "part int, file int, start long, tokens long, path string"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = manifest.sparkSession
    totals = sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("tokens")).collect())  # one row for each partition
    base, before = {}, 0
    for part, tokens in totals:
        base[part], before = before, before + tokens
    bases = spark.createDataFrame(list(base.items()), "part int, base long")
    files = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("start")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch["path"], batch["start"], strict=True):
                file = TokenFile(get_bytes(uri))
                ids, (names, lengths) = np.ascontiguousarray(file.tokens(), dtype="<u4"), file.documents()
                stops = np.cumsum(lengths, dtype=np.int64)
                crcs = [zlib.crc32(ids[b - n : b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(names, dtype="Int64"), "start": start + stops - lengths, "n_tokens": lengths, "ids_crc32": crcs}
                )

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(totals))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return files.repartition(tasks, "path").mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))


QUERIES = {"op9_token_store": query}
ORACLE_SQL: dict[str, str] = {}
