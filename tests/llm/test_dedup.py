"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bitplanes, common, exact_dedup, simhash
from quillon.llm.common import table
from quillon.llm.components import components

SCHEMA = "doc_id long, text string, digest string, first string"


def normal(text: str | None) -> str:
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute_exact(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for body, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        kept_one = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = i == low and not kept_one
            kept_one |= kept
            out.append((i, low, len(ids), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (4, "a b"), (2, "a \t b"), (3, "a b"), (None, "a  b"), (1, None), (7, ""), (8, " "), (9, "\n\n"), (2, "a b"),
    (10, "é" * 100_000), (11, "é" * 100_000), (12, "A b"), (None, "q"), (None, "q"), (13, "a b "), (14, "a b\r\n"),
]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.substring(F.sha2(body, 256), 1, 1), lambda body: F.lit("same")])
def test_exact_duplicates_whatever_the_digest(spark, digest):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ODD], SCHEMA)
    found = exact_dedup.exact_duplicates(docs, digest).join(
        spark.createDataFrame([], "z int"), F.lit(True), "left"
    )
    got = sorted((tuple(r)[1:5] for r in found.select("digest", "doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted((r[:4] for r in brute_exact(ODD)), key=repr)


def test_exact_query_on_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = exact_dedup.query(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_drop_duplicates_keeps_whole_rows(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ODD], SCHEMA)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in brute_exact(ODD) if r[3]), key=repr)
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(params=[None, 0], ids=["broadcast", "shuffle"])
def broadcast_limit(request, monkeypatch, spark):
    """The side of every size check: tables within the limit, and all tables beyond it."""
    if request.param is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", request.param)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_duplicates_on_both_sides_of_the_broadcast_bound(spark, broadcast_limit):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ODD], SCHEMA)
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:4] for r in brute_exact(ODD)), key=repr)
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted((r[0] for r in brute_exact(ODD) if r[3]), key=repr)


def test_near_duplicates_on_both_sides_of_the_broadcast_bound(spark, broadcast_limit):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_components([(i, brute_fingerprint(t)) for i, t in rows]), strict=True))


def test_merge_index_levels_and_filters(spark):
    index = exact_dedup.MergeIndex.of(spark, 4000)
    want: dict[bytes, list[int]] = {}
    for flush, low in enumerate((0, 900, 1800, 2000, 5000)):
        ids = range(low, low + 1000)
        rows = [(hashlib.sha256(str(i).encode()).digest(), 10_000 * flush + i) for i in ids]
        entries = spark.createDataFrame([(d, i, i) for d, i in rows], "digest binary, doc_id long, seq long")
        hits = {bytes(r["digest"]) for r in index.add(entries).collect()}
        assert hits == {d for d, _ in rows if d in want}
        for d, i in rows:
            want.setdefault(d, []).append(i)
    # Four flushes were merged in pairs, and the pairs again; one waits in the first level.
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert index.levels[2][0].rows == 3000 and index.levels[0][0].rows == 1000
    # Of the digests that a run doesn't hold, its filter lets few pass.
    asked, passed = (sum(p) for p in zip(*index.probes, strict=True))
    assert asked == 1000 * 5 and 1000 <= passed <= 1000 + 0.03 * asked
    some = spark.createDataFrame([(d,) for d in list(want)[::7]], "digest binary")
    found = {bytes(r["digest"]): (r["first"]["id"], r["entries"]) for r in index.lookup(some).collect()}
    assert found == {d: (min(want[d]), len(want[d])) for d in list(want)[::7]}
    level = index.compact()
    assert {bytes(r["digest"]): (r["first"]["id"], r["entries"]) for r in level.collect()} == {d: (min(i), len(i)) for d, i in want.items()}
    assert [len(level) for level in index.levels] == [0, 0, 1]


def test_runs_are_merged_without_a_shuffle(spark):
    index = exact_dedup.MergeIndex.of(spark, 100)
    entries = spark.range(100).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("seq"))
    index.add(entries)
    index.add(entries)
    old = index.levels[1][0]
    assert old.rows == 100
    merged = index.merged(old, old)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.count() == 100 and merged.agg(F.sum("entries")).first()[0] == 400


def brute_fingerprint(text: str | None) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple[int | None, int]]) -> list[int | None]:
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f: int) -> int:
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    array = np.array(fps, dtype=np.uint64)
    for f in fps:
        for g in array[np.bitwise_count(array ^ np.uint64(f)) <= simhash.RADIUS].tolist():
            root[find(g)] = find(f)
    low: dict[int, int] = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [low.get(find(f)) for _, f in rows]


def check_near(rows: list[tuple], found: list[tuple]) -> None:
    made = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(made, brute_components(made), strict=True)), key=repr)
    assert sorted(found, key=repr) == want


def near(docs) -> list[tuple]:
    return [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()]


def test_near_query_on_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    check_near(rows, [tuple(r) for r in simhash.query(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()])


def test_near_on_odd_texts(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    long = [rng.choice(words) for _ in range(20_000)]
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One"), (9, "one"), (10, "one two"), (11, "ONE Two THREE"), (None, "one two"), (12, " ".join(long))]
    rows += [(13, " ".join([*long[:-1], "other"])), (12, " ".join(long)), (None, None), (14, "É é"), (15, "é É"), (16, "a b c " * 9000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    check_near(rows, near(docs))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_links_in_blocks_of_one_key(spark, monkeypatch):
    """Fingerprints that share many bits, compared through small blocks, with chains over several links."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = np.random.default_rng(1)
    base = np.uint64(0x0123456789ABCDEF)
    fps = {int(base)}
    for _ in range(500):
        flips = rng.choice(64, rng.integers(1, 9), replace=False)
        fps.add(int(base) ^ sum(1 << int(b) for b in flips))
    signed = [int(np.array([f], dtype=np.uint64).view(np.int64)[0]) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    got: dict[int, set] = {}
    for f in signed:
        got.setdefault(root.get(f, f), set()).add(f & (1 << 64) - 1)
    rows = list(enumerate(sorted(fps)))
    want: dict[int, set] = {}
    for (_, f), c in zip(rows, brute_components(rows), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 333, dtype=np.uint64)
    near_ = values.copy()
    for k in range(len(near_)):
        for b in rng.choice(64, rng.integers(0, 10), replace=False):
            near_[k] ^= np.uint64(1) << np.uint64(b)
    assert bitplanes.paired(values, near_, radius).tolist() == np.flatnonzero(np.bitwise_count(values ^ near_) <= radius).tolist()
    hit = bitplanes.unpack(bitplanes.neighbours(bitplanes.planes(near_), int(values[7]), radius), len(values))
    assert hit.tolist() == np.flatnonzero(np.bitwise_count(near_ ^ values[7]) <= radius).tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(k, 0) for k in range(200)}


def test_near_copies_without_or_with_repeated_identifiers_leave_one_row(spark):
    near, other = "one two three four five six seven", "entirely different words stand in this other document"
    rows = [
        (None, near, 1), (None, near + " ", 2), (7, near, 3), (None, other, 4), (None, other, 5), (7, "a text of its own that shares an identifier", 6),
        (9, near, 7), (9, "one more clean text under the identifier nine", 8), (None, "alone without identifier here", 9), (3, "x y z w", 10), (3, "x y z w", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = sorted(r["n"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept in ([3, 4, 6, 8, 9, 10], [3, 5, 6, 8, 9, 10], [3, 4, 6, 8, 9, 11], [3, 5, 6, 8, 9, 11])
