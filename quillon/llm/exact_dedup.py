"""Exact deduplication by a log-structured merge index of digests.

The index takes (digest, doc_id) entries in generations.  A generation is a
memtable: it is aggregated by digest and flushed as one run, sorted by digest in
hash buckets, with a Bloom filter beside it.  A flush asks the filters of all older
runs about its digests; what passes a filter is looked up in that run, and
digests found there, or more than once in the flush itself, are hits.  When a level
holds ``FANOUT`` runs, compaction merges both into one run of the next level and
keeps the smallest identifier of each digest.  All runs of an index have the same
buckets, so that lookups and merges read them in place, without a shuffle.

Hits receive byte verification: the smallest and the largest normalised text of a
digest are gathered (combined before the exchange, so that a hot digest brings two
texts of each task at most) and must be equal; digests for which they aren't are
resolved by whole texts.

Only digests are shuffled for all rows; texts move for hits alone.  If the hits are
too many to broadcast, a filter of bounded size over them takes out most other rows
before texts are shuffled.  All of it is DataFrame code.

Defined results: a null text counts as empty; texts of any length are read whole; a
null doc_id sorts after all others; of repeated rows with the smallest doc_id
exactly one is kept; an empty table gives an empty result; other columns of the
input, whatever their names, are ignored (and pass ``drop_duplicates`` untouched).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.common import bounded, fresh_dir, measured_bytes, table, written

#: Bytes that one digest entry takes when it is broadcast, with hash-table overhead.
ENTRY_BYTES = 256
#: Flushes of one input, and runs of a level that are merged into one.
GENERATIONS, FANOUT = 4, 2
#: Digests of a bucket, and of one of an index so small that it has fewer buckets than there are shuffle partitions.
BUCKET_ROWS, SMALL_ROWS = 2_000_000, 200_000
#: Bits of a filter block (fixed by Spark's bitmap functions), and for each digest.
BLOCK_BITS, DIGEST_BITS = 32_768, 16
BLOCK_BYTES = BLOCK_BITS // 8


def normalised(text: Column) -> Column:
    """White-space runs become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]++", " ")


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def first_of(doc_id: str = "doc_id", *rest: str) -> Column:
    """Sort key under which the smallest identifier stays and null comes last."""
    return F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), *[F.col(c) for c in rest])


class DigestFilter:
    """A Bloom filter over digests as a table of bitmap blocks.

    A block belongs to one bucket, so that every task of a bucketed run fills
    its own blocks only.
    """

    def __init__(self, digests: DataFrame, rows: int, buckets: int, limit: int | None = None):
        """``limit`` bounds the bytes; a filter cut short passes more digests, never fewer."""
        self.buckets = buckets
        wanted = max(1, -(-rows * DIGEST_BITS // BLOCK_BITS // buckets))
        self.blocks = wanted if limit is None else max(1, min(wanted, limit // BLOCK_BYTES // buckets))
        places = F.explode(F.array(*[self._place(k) for k in (1, 2)])).alias("place")
        bits = digests.select(self._block().alias("block"), places).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
        self.table = written(bits, "filter")

    @property
    def bytes(self) -> int:
        return self.blocks * self.buckets * BLOCK_BYTES

    def _block(self) -> Column:
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets)).cast("long")
        return bucket * self.blocks + F.pmod(F.xxhash64("digest", F.lit(0)), F.lit(self.blocks))

    @staticmethod
    def _place(k: int) -> Column:
        return F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(BLOCK_BITS))

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a boolean ``name``: false only if the digest is surely not in the filter."""
        block, bits = f"{name}_block", f"{name}_bits"
        held = F.broadcast(self.table.select(F.col("block").alias(block), F.col("bits").alias(bits)))
        joined = rows.withColumn(f"{name}_own", self._block()).join(held, F.col(f"{name}_own") == F.col(block), "left")

        def bit(k: int) -> Column:
            place = f"pmod(xxhash64(digest, {k}), {BLOCK_BITS})"
            return F.expr(f"(cast(conv(hex(substring({bits}, cast({place} div 8 + 1 as int), 1)), 16, 10) as int) & shiftleft(1, cast({place} % 8 as int))) != 0")

        return joined.withColumn(name, F.coalesce(bit(1) & bit(2), F.lit(False))).select(*rows.columns, name)

    def passed(self, rows: DataFrame) -> DataFrame:
        return self.marked(rows, "__quillon_in").where("__quillon_in").select(*rows.columns)


@dataclass
class Run:
    """A sorted run: (digest, first, entries), its number of digests and its filter (None if that is too large to broadcast)."""

    table: DataFrame
    rows: int
    filter: DigestFilter | None


@dataclass
class MergeIndex:
    """Digest index in the shared folder: ``add`` flushes a run, ``lookup`` reads all runs."""

    spark: SparkSession
    buckets: int
    root: str
    levels: list[list[Run]] = field(default_factory=list)
    #: For each lookup of a flush in an older run: (digests asked for, digests that passed the filter).
    probes: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, spark: SparkSession, rows: int, root: str | None = None) -> MergeIndex:
        """An index for about ``rows`` digests.

        The number of buckets is a multiple of that of shuffle partitions, so
        that the aggregation's exchange deals whole buckets to its tasks; a
        small index has fewer, so that its runs aren't scattered over files.
        """
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        few = max(1, -(-rows // SMALL_ROWS))
        return cls(spark, few if few <= least else least * -(-rows // (BUCKET_ROWS * least)), root or fresh_dir(spark, "lsm"))

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _write(self, merged: DataFrame) -> Run:
        """One run, sorted in buckets; the catalog forgets it at once, the reader keeps its layout."""
        name = f"quillon_run_{uuid.uuid4().hex}"
        writer = merged.write.bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", f"{self.root}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        rows = run.count()
        size = max(1, -(-rows * DIGEST_BITS // BLOCK_BITS // self.buckets)) * self.buckets * BLOCK_BYTES
        return Run(run, rows, DigestFilter(run.select("digest"), rows, self.buckets) if size <= common.BROADCAST_BYTES else None)

    def add(self, entries: DataFrame) -> DataFrame:
        """Flush (digest, doc_id, seq) entries; returns the digests that occur in older runs or more than once here."""
        own = entries.groupBy("digest").agg(F.min(first_of("doc_id", "seq")).alias("first"), F.count(F.lit(1)).alias("entries"))
        run = self._write(own)
        hits = written(run.table.where("entries > 1").select("digest"), "hits")
        for old in self.runs:
            asked = run.table.select("digest")
            if old.filter is not None:
                asked = bounded(written(old.filter.passed(asked), "passed"), ENTRY_BYTES)
                self.probes.append((run.rows, asked.count()))
            hits = hits.unionByName(written(old.table.select("digest").join(asked, "digest", "left_semi"), "hits"))
        self._push(run, 0)
        return hits.distinct()

    def _push(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            merged = self._write(self.merged(*self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    @staticmethod
    def merged(a: Run, b: Run) -> DataFrame:
        """Two runs merged bucket by bucket.

        A join, not a union with an aggregation: Spark 4.1 takes a union of
        bucketed scans for co-located and then leaves rows of one digest apart.
        """
        b = b.table.select(*[F.col(c).alias(f"{c}_b") for c in ("digest", "first", "entries")])
        both = a.table.join(b.hint("merge"), F.col("digest") == F.col("digest_b"), "full")
        count = F.coalesce("entries", F.lit(0)) + F.coalesce("entries_b", F.lit(0))
        return both.select(F.coalesce("digest", "digest_b").alias("digest"), F.least("first", "first_b").alias("first"), count.cast("long").alias("entries"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, first, entries) of the written ``digests`` over all runs."""
        wanted, found = bounded(digests, ENTRY_BYTES), None
        for run in self.runs:
            part = written(run.table.join(wanted, "digest", "left_semi"), "found")
            found = part if found is None else found.unionByName(part)
        return found.groupBy("digest").agg(F.min("first").alias("first"), F.sum("entries").alias("entries"))

    def compact(self) -> DataFrame:
        """Merge the runs of all levels into one, the smallest first, and return it."""
        runs = sorted(self.runs, key=lambda r: r.rows)
        while len(runs) > 1:
            runs = sorted([self._write(self.merged(*runs[:2])), *runs[2:]], key=lambda r: r.rows)
        self.levels = [*[[] for _ in self.levels[1:]], runs]
        return runs[0].table


class _Groups:
    """Rows of the digests that occur more than once, (group_digest, ...), and what joins texts with them."""

    def __init__(self, groups: DataFrame):
        self.table = groups
        self.small = measured_bytes(groups, ENTRY_BYTES) <= common.BROADCAST_BYTES
        self.filter = None
        if not self.small:
            # One bucket for each block: the filter stands by itself.
            rows = groups.count()
            buckets = max(1, min(rows * DIGEST_BITS // BLOCK_BITS, common.BROADCAST_BYTES // BLOCK_BYTES))
            self.filter = DigestFilter(groups.select(F.col("group_digest").alias("digest")), rows, buckets, common.BROADCAST_BYTES)

    def hits(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a digest of a group."""
        if self.small:
            return rows.join(F.broadcast(self.table), F.col("digest") == F.col("group_digest"))
        return self.filter.passed(rows).join(self.table, F.col("digest") == F.col("group_digest"))

    def left(self, rows: DataFrame) -> DataFrame:
        """All ``rows``, those of a group with its columns; the others don't move."""
        same = F.col("digest") == F.col("group_digest")
        if self.small:
            return rows.join(F.broadcast(self.table), same, "left")
        marked = self.filter.marked(rows, "__quillon_in")
        inside = marked.where("__quillon_in").drop("__quillon_in").join(self.table, same, "left")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema]
        return inside.unionByName(marked.where("NOT __quillon_in").select(*rows.columns, *nulls))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: digest, doc_id, keep_id, group_size, kept.

    ``digest`` maps the normalised text to the index key, a binary or string.
    Any digest gives right results; weak ones cost more verification.
    """
    spark = docs.sparkSession
    normal = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
    numbered = normal.select("digest", "doc_id", F.monotonically_increasing_id().alias("seq"), F.pmod(F.spark_partition_id(), F.lit(GENERATIONS)).alias("generation"))
    entries = written(numbered, "entries", partition="generation")
    sizes = sorted(tuple(r) for r in entries.groupBy("generation").count().collect())  # GENERATIONS rows at most
    entries_of = entries.select("digest", "doc_id", "seq")
    if not sizes:
        return entries_of.select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    index = MergeIndex.of(spark, sum(n for _, n in sizes))
    hits = None
    for generation, _ in sizes:
        found = index.add(entries.where(F.col("generation") == generation))
        hits = found if hits is None else hits.unionByName(found)
    groups = index.lookup(written(hits.distinct(), "hits")).select(
        F.col("digest").alias("group_digest"), F.col("first.id").alias("first_id"), F.col("first.seq").alias("first_seq"), "entries"
    )
    groups = _Groups(written(groups, "groups"))
    # Byte verification: texts of hits, nothing else.
    ends = groups.hits(normal).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    wrong = written(ends.where("low != high").select("digest"), "collisions")
    rows = groups.left(entries_of).select(
        "digest",
        "doc_id",
        F.when(F.col("entries").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("entries", F.lit(1)).cast("long").alias("group_size"),
        (F.col("entries").isNull() | (F.col("seq") == F.col("first_seq"))).alias("kept"),
    )
    if wrong.isEmpty():
        return rows
    # Distinct texts share a digest: those digests are grouped by whole texts instead.
    clash = normal.join(bounded(wrong, ENTRY_BYTES), "digest", "left_semi").withColumn("seq", F.monotonically_increasing_id())
    clash = written(clash, "clash")
    exact = clash.groupBy("digest", "body").agg(
        F.min(first_of("doc_id", "seq")).alias("first"), F.count(F.lit(1)).alias("entries")
    )
    resolved = clash.join(exact, ["digest", "body"]).select(
        "digest",
        "doc_id",
        F.col("first.id").alias("keep_id"),
        F.col("entries").alias("group_size"),
        (F.col("seq") == F.col("first.seq")).alias("kept"),
    )
    return rows.join(bounded(wrong, ENTRY_BYTES), "digest", "left_anti").unionByName(resolved)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Members of groups are found by digest; documents outside any group pass
    untouched, without a shuffle.  Repeated rows (equal text and identifier)
    leave one row.
    """
    ids, mark = "__quillon_ids", "__quillon_mark"
    result = written(exact_duplicates(docs).where("group_size > 1"), "members")
    stay = result.groupBy(F.col("digest").alias("group_digest")).agg(
        F.collect_set(F.when(F.col("kept"), F.col("keep_id"))).alias(ids),
        F.max(F.col("kept") & F.col("keep_id").isNull()).alias("__quillon_missing"),
    )
    # The document's own columns stand in a struct, so that names can't clash.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    tagged = docs.select(own, sha256(normalised(F.col("text"))).alias("digest"))
    joined = _Groups(written(stay, "stay")).left(tagged)
    passes = F.array_contains(ids, F.col("own.doc_id")) | (F.col("own.doc_id").isNull() & F.col("__quillon_missing"))
    kept = joined.where(F.col(ids).isNull() | passes).select("own", F.col("digest").alias(mark))
    repeats = result.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    if repeats.isEmpty():
        return kept.select("own.*")
    again = bounded(written(repeats.select(F.col("digest").alias(mark)).distinct(), "repeats"), ENTRY_BYTES)
    single = kept.join(again, mark, "left_semi").withColumn("id", F.col("own.doc_id")).dropDuplicates([mark, "id"]).drop("id")
    return kept.join(again, mark, "left_anti").unionByName(single).select("own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op3_exact_dedup": query}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
    SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM n JOIN g USING (body)
"""
}
