"""SimHash near-duplicates with bit-sliced Hamming comparison.

A fingerprint has a bit set if over half of the XXH64 values of the text's
3-word shingles have it.  Fingerprints link at 3 or fewer differing bits, and
links close transitively.

Candidates are exact: of five bit ranges at least two agree whenever three bits
differ, so each distinct fingerprint goes under ten keys of 25 or 26 bits, and
every link shows under one of them.  Keys that hold many fingerprints are refined:
of four parts of the bits outside the key at least one agrees as well, so their
fingerprints go under four longer keys each.  Fingerprints under one key are
compared bit-sliced.  Keys that still hold many are cut into blocks, and every
pair of blocks is a task of bounded size; a fingerprint is sent once for each
block of its key, so that work grows with the square of what differs and yet
agrees in about 36 bits.  A task returns a spanning forest of its links, never all
pairs; large-star/small-star joins the forests.

Equal fingerprints are collapsed before any comparison, so that copies, however
many, cost one row.

Defined results: a null, empty or blank text has fingerprint zero, linked like
any other; texts of any length count whole; a null doc_id takes part, and its
group's component_id is the smallest non-null one (null if there is none);
repeated rows are returned as often as they occur; other input columns, whatever
their names, are ignored (and pass ``drop_near_duplicates`` untouched); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bitplanes import neighbours, paired, planes, unpack
from quillon.llm.common import bounded, per_text, table, utf8, written
from quillon.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bit ranges (offset, width); two of them make a key.
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one key in one block; a task compares two blocks.
BLOCK = 4096
#: Marks refined keys.
REFINED = 1 << 60
#: Groups up to this size are compared pair by pair of offsets, many groups at once.
SMALL = 32
ENTRY_BYTES = 64
#: The same of an entry with an identifier and a digest.
ROW_BYTES = 256


def fingerprint(text: str | None) -> int:
    words = utf8(text).lower().split() if text else []
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n < SHINGLE:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter(
        (digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:], strict=False)), dtype="<u8", count=n - 2
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n - 2, 1 << 16):  # bounded, whatever the text's length
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n - 2, bitorder="little").tobytes(), "little")


def _fingerprints(texts: list[str | None]) -> tuple[np.ndarray]:
    return (np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64),)


def _bits(offset: int, width: int) -> F.Column:
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def candidate_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): ten keys of each fingerprint, one for each pair of bit ranges."""
    keys = []
    for t, (a, b) in enumerate(combinations(RANGES, 2)):
        keys.append(F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(_bits(*a), 13) + _bits(*b))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def refined_keys(rows: DataFrame) -> DataFrame:
    """(key, fp) under four longer keys for each (key, fp): the key with a quarter of the bits outside it."""
    number = F.shiftrightunsigned("key", 32)
    out = None
    for t, (a, b) in enumerate(combinations(RANGES, 2)):
        rest = [o + k for o, w in RANGES if (o, w) not in (a, b) for k in range(w)]
        parts = [rest[k * len(rest) // 4 : (k + 1) * len(rest) // 4] for k in range(4)]
        longer = []
        for p, bits in enumerate(parts):
            # Neighbouring bits of a part are taken together.
            value, shift = F.lit(0).cast("long"), 0
            for offset, width in _stretches(bits):
                value, shift = value + F.shiftleft(_bits(offset, width), shift), shift + width
            longer.append(F.lit(REFINED) + F.shiftleft(F.col("key"), 12) + F.shiftleft(F.lit(p).cast("long"), 10) + value)
        longer = F.array(*longer)
        out = F.when(number == t, longer) if out is None else out.when(number == t, longer)
    return rows.select("fp", F.explode(out).alias("key"))


def _stretches(bits: list[int]) -> list[tuple[int, int]]:
    """(offset, width) of the runs of neighbouring numbers."""
    found: list[tuple[int, int]] = []
    for b in bits:
        if found and b == sum(found[-1]):
            found[-1] = found[-1][0], found[-1][1] + 1
        else:
            found.append((b, 1))
    return found


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position linked to each of n positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small_groups(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(group[:-d] == group[d:]) if d < len(group) else ()
        if not len(i):
            break
        hit = i[paired(fp[i], fp[i + d], RADIUS)]
        left.append(hit)
        right.append(hit + d)
    if not left:
        return fp[:0], fp[:0]
    label = _labels(len(fp), np.concatenate(left), np.concatenate(right))
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def _large_group(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of one group: every fingerprint is compared once with the block's planes."""
    n, block = len(fp), planes(fp)
    root, waiting = np.full(n, -1), np.ones(n, dtype=bool)
    for start in range(n):
        if root[start] >= 0:
            continue
        queue, root[start], waiting[start] = [start], start, False
        while queue:
            near = unpack(neighbours(block, int(fp[queue.pop()]), RADIUS), n)
            near = near[waiting[near]]
            root[near], waiting[near] = start, False
            queue.extend(near.tolist())
    at = np.flatnonzero(root != np.arange(n))
    return fp[at], fp[root[at]]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of groups of equal (key, i, j); rows come sorted by them."""
    rest: pd.DataFrame | None = None

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["key", "i", "j"]].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (key[1:] != key[:-1]).any(axis=1)
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        small = size[group] <= SMALL
        found = [_small_groups(group[small], fp[small])]
        starts = np.flatnonzero(first)
        found += [_large_group(fp[starts[g] : starts[g] + size[g]]) for g in np.flatnonzero(size > SMALL)]
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pd.DataFrame({"u": u, "v": v})

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows[["key", "i", "j"]].iloc[-1]
        open_ = ((rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])).to_numpy()
        rest = rows[open_]
        if not open_.all():
            yield forest(rows[~open_])
    if rest is not None and len(rest):
        yield forest(rest)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all links between distinct fingerprints."""

    def counted(keys: DataFrame) -> DataFrame:
        return written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")

    keys = candidate_keys(distinct)
    shared = counted(keys)
    crowded = shared.where(F.col("n") > BLOCK)
    if not crowded.isEmpty():
        crowded = bounded(written(crowded.select("key"), "crowded"), ENTRY_BYTES)
        refined = written(refined_keys(keys.join(crowded, "key", "left_semi")), "refined")
        shared = shared.where(F.col("n") <= BLOCK).unionByName(counted(refined))
        keys = keys.join(crowded, "key", "left_anti").select("fp", "key").unionByName(refined)
    shared = bounded(shared, ENTRY_BYTES)
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    rows = keys.join(shared, "key").select("key", "fp", own.alias("own"), blocks.cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = rows.select("key", "fp", "own", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    dealt = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(_links, "u long, v long")


def _with_components(docs: DataFrame, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """(doc_id, fp, component) of every document; component is the smallest doc_id of several rows that are linked."""
    made = written(per_text(docs, "fp long", _fingerprints), "fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = links(distinct.select("fp"))
    roots = written(components(edges).withColumnRenamed("node", "fp"), "roots")
    grouped = distinct.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component"), F.sum("n").alias("members")).where("members > 1")
    several = written(grouped.join(lowest, "root").select("fp", "component"), "several")
    return made.join(bounded(several, entry_bytes), "fp", "left").select("doc_id", "fp", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    return _with_components(docs).select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component one row.

    It is the one with the smallest doc_id, null last, and of those the smallest
    SHA-256 of the text.  Rows are told apart by both, which a second read of
    ``docs`` gives again, unlike row numbers; of rows equal in both one stays.
    """
    mark, id_ = "__quillon_digest", "__quillon_id"
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), digest.alias("digest"))
    found = _with_components(docs.select(row.alias("doc_id"), "text"), ROW_BYTES).where("component IS NOT NULL")
    members = written(found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")), "members")

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id.id").alias(id_), F.col("doc_id.digest").alias(f"{mark}_of"))

    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(f"{mark}_of"))
    dropped = bounded(written(keys(members.where("NOT kept")).distinct(), "dropped"), ROW_BYTES)
    stay = docs.withColumn(mark, digest).join(dropped, same, "left_anti")
    repeats = members.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = written(keys(repeats), "repeats")
    if repeats.isEmpty():
        return stay.select(*docs.columns)
    repeats = bounded(repeats, ROW_BYTES)
    single = stay.join(repeats, same, "left_semi").dropDuplicates([mark, "doc_id"])
    return stay.join(repeats, same, "left_anti").unionByName(single).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": query}
ORACLE_SQL: dict[str, str] = {}
