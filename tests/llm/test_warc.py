"""Archives: exact round trips, and salvage of damaged bytes against what was left whole."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, warc
from quillon.llm.common import get_bytes, put_bytes, fresh_dir


def sample(n: int = 12, seed: int = 0) -> list[bytes]:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = f"<html>{k} WARC/1.0\r\n\x1f\u008b ".encode() + rng.randbytes(rng.randrange(0, 3000))
        out.append(warc.record(k, f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None, False))
    return out


def ids(found: list) -> list[str]:
    return [f[2].headers["warc-record-id"] for f in found if not isinstance(f, warc.Gap)]


def gaps(found: list) -> list[tuple[int, int]]:
    return [(f.start, f.end) for f in found if isinstance(f, warc.Gap)]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives_have_no_gaps(packed):
    parts = [warc.member(r) if packed else r for r in sample()]
    found = list(warc.salvage(b"".join(parts)))
    assert ids(found) == [warc.record_id(k) for k in range(12)] and not gaps(found)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_damage_costs_only_the_damaged_records(packed, seed):
    rng = random.Random(seed)
    parts = [bytearray(warc.member(r) if packed else r) for r in sample(seed=seed)]
    hurt = set(rng.sample(range(12), 4))
    for k in hurt:
        how = rng.randrange(3)
        at = rng.randrange(len(parts[k]) // 3, len(parts[k]) - 12)
        if how == 0:
            parts[k][at] ^= 0x55
        elif how == 1:
            del parts[k][at:]
        else:
            parts[k][at:at] = rng.randbytes(50)
    data = b"".join(parts)
    found = list(warc.salvage(data))
    assert ids(found) == [warc.record_id(k) for k in range(12) if k not in hurt]
    # Records and gaps cover every byte once, in order.
    edges = sorted({(f.start, f.end) if isinstance(f, warc.Gap) else f[:2] for f in found})
    assert edges[0][0] == 0 and edges[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(edges, edges[1:], strict=False))
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    for a, b in gaps(found):
        assert all(k in hurt for k in range(12) if starts[k] >= a and starts[k + 1] <= b)


def test_junk_before_between_and_behind():
    parts = [warc.member(r) for r in sample(3)]
    data = b"junk" + parts[0] + b"\x1f\x8b\x08 not a member" + parts[1] + gzip.compress(b"no version line") + parts[2] + b"\x00" * 20
    found = list(warc.salvage(data))
    assert ids(found) == [warc.record_id(k) for k in range(3)] and len(gaps(found)) == 4


def test_sound_member_with_a_wrong_digest_is_quarantined():
    good, bad = sample(2)
    bad = bad.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0")
    found = list(warc.salvage(warc.member(good) + warc.member(bad) + warc.member(good)))
    assert len(ids(found)) == 2 and [f.reason for f in found if isinstance(f, warc.Gap)] == ["payload digest differs"]


def test_several_records_in_one_member_and_empty_archives():
    found = list(warc.salvage(warc.member(b"".join(sample(3)))))
    assert len(ids(found)) == 3
    assert list(warc.salvage(b"")) == []
    assert gaps(list(warc.salvage(b"nothing"))) == [(0, 7)]


def test_bad_records_of_a_grouped_member_cost_only_themselves():
    parts = sample(6)
    parts[1] = parts[1].replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0")
    parts[4] = parts[4].replace(b"WARC-Date: ", b"WARC-Date ", 1).replace(b"Date 2024-01-01T00:00:00Z", b"Date")
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    data = warc.member(b"".join(parts))
    found = list(warc.salvage(data + warc.member(sample(1)[0])))
    assert ids(found) == [warc.record_id(k) for k in (0, 2, 3, 5, 0)]
    assert [f.inner for f in found if isinstance(f, warc.Gap)] == [(starts[1], starts[2]), (starts[4], starts[5])]
    assert all((f.start, f.end) == (0, len(data)) for f in found if isinstance(f, warc.Gap))


@pytest.mark.parametrize("level", [0, 4])
def test_one_stream_cut_short_or_broken_gives_the_records_before(level):
    parts = sample(40)
    data = warc.member(b"".join(parts), level)
    cut = list(warc.salvage(data[: len(data) * 2 // 3]))
    n = len(ids(cut))
    assert 20 < n < 30 and ids(cut) == [warc.record_id(k) for k in range(n)] and [f.reason for f in cut if isinstance(f, warc.Gap)] == ["unfinished member"]
    hurt = bytearray(data)
    hurt[len(data) // 2 : len(data) // 2 + 600] = b"\xff" * 600
    found = list(warc.salvage(bytes(hurt) + warc.member(parts[0])))
    sound = [r for r in found if not isinstance(r, warc.Gap)]
    assert ids(found)[:10] == [warc.record_id(k) for k in range(10)] and ids(found)[-1] == warc.record_id(0) and len(gaps(found)) >= 1
    whole = {warc.record_id(k): next(warc.salvage(p))[2].block for k, p in enumerate(parts)}
    assert all(whole[r[2].headers["warc-record-id"]] == r[2].block for r in sound)


def test_a_checksum_that_tells_no_place_quarantines_the_member():
    data = bytearray(warc.member(b"".join(sample(3)), 0))
    at = data.find(b"http://x/1")
    data[at] ^= 1
    assert ids(list(warc.salvage(bytes(data)))) == []


def with_magic(k: int) -> bytes:
    body = b"\x1f\x8b\x08 no member " + gzip.compress(b"text") + bytes([k])
    return warc.record(k, f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None, False)


def test_plain_archive_with_gzip_bytes_and_a_damaged_start():
    parts = [with_magic(k) for k in range(4)]
    data = b"junk" + b"".join(parts)
    found = list(warc.salvage(data))
    assert ids(found) == [warc.record_id(k) for k in range(4)] and gaps(found) == [(0, 4)]
    found = list(warc.salvage(b"X" + b"".join(parts)[1:]))
    assert ids(found) == [warc.record_id(k) for k in range(1, 4)] and gaps(found) == [(0, len(parts[0]))]


def test_members_and_plain_records_in_one_file():
    parts = [warc.member(with_magic(0)), with_magic(1), b"\x1f\x8b\x08junk", with_magic(2), b"junk", warc.member(with_magic(3)), with_magic(4)]
    found = list(warc.salvage(b"".join(parts)))
    assert ids(found) == [warc.record_id(k) for k in range(5)] and len(gaps(found)) == 2


@pytest.mark.parametrize("level", [0, 4])
def test_a_cut_member_before_others_gives_no_record_twice(level):
    parts = [warc.member(r, level) for r in sample(4)]
    found = list(warc.salvage(parts[0] + parts[1][: len(parts[1]) // 2] + parts[2] + parts[3]))
    assert ids(found) == [warc.record_id(k) for k in (0, 2, 3)]


def brute(rows: list[tuple]) -> list[tuple]:
    first: dict[bytes, int | None] = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            known = first.setdefault(body, page_id)
            if known is None or (page_id is not None and page_id < known):
                first[body] = page_id
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        at = first.get(body, page_id)
        revisit = len(body) >= 100 and at != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", at if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "shuffle"])
def test_odd_pages(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    long = "é" * 60
    rows = [
        (5, "http://a/", long), (3, "http://b/\r\nX: y", long), (None, None, long), (3, "http://b2/", long), (9, "http://c/", "short"),
        (8, "http://d/", "short"), (0, "t", "z" * 120), (0, "t", "w" * 150), (6, "t", "z" * 120), (6, "t", "w" * 150), (1, "u", None), (2, "u", ""), (7, "u", "x" * 200_000), (None, None, "y" * 100), (None, None, "y" * 100),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    records, quarantine = warc.read_warc(warc.write_warc(pages))
    found = records.select(warc.page_of("record_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to")).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert quarantine.count() == 0


@pytest.mark.parametrize("claimed", [True, False])
def test_revisits_of_one_identifier_with_two_payloads(spark, claimed):
    """Each takes length and digest of the payload that it repeats; without a digest of its own it takes none."""
    a, b = b"a" * 200, b"b" * 150
    parts = [warc.record(1, "u", p, hashlib.sha256(p).hexdigest(), None, False) for p in (a, b)]
    parts += [warc.record(k, "u", p, hashlib.sha256(p).hexdigest(), 1, True) for k, p in ((2, a), (3, b))]
    if not claimed:
        parts[2:] = [re.sub(rb"WARC-Payload-Digest: [^\r]*\r\n", b"", p) for p in parts[2:]]
    uri = f"{fresh_dir(spark, 'two')}/two.warc.gz"
    put_bytes(uri, b"".join(map(warc.member, parts)))
    records, quarantine = warc.read_warc(spark.createDataFrame([(uri,)], "path string"))
    found = {warc_id: (n, d) for warc_id, n, d in records.where("record_type = 'revisit'").select("record_id", "payload_bytes", "payload_digest").collect()}
    want = {2: a, 3: b}
    none = (None, None)
    assert found == {warc.record_id(k): (len(p), hashlib.sha256(p).hexdigest()) if claimed else none for k, p in want.items()}
    assert quarantine.count() == 0


def test_very_long_urls(spark):
    urls = {1: "data:text/html," + "x" * 2_000_000, 2: "http://a/" + "\n" * 700_000, 3: "http://b/"}
    pages = spark.createDataFrame([(k, u, "short") for k, u in urls.items()], "page_id long, url string, html string")
    records, quarantine = warc.read_warc(warc.write_warc(pages))
    found = {r["page_id"]: r["target_uri"] for r in records.select(warc.page_of("record_id").alias("page_id"), "target_uri").collect()}
    assert found == {k: u.replace("\n", "%0A") for k, u in urls.items()} and quarantine.count() == 0
    plain = warc.record(1, urls[1], b"", hashlib.sha256(b"").hexdigest(), None, False)
    assert ids(list(warc.salvage(plain * 2))) == [warc.record_id(1)] * 2


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    records, quarantine = warc.read_warc(warc.write_warc(pages))
    assert records.count() == 0 and quarantine.count() == 0


def test_payloads_survive_and_gaps_are_logged(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = warc.write_warc(pages)
    wanted = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    found = warc.scan(archives, payloads=True).select(warc.page_of("record_id").alias("page_id"), "payload", "record_type").collect()
    assert len(found) == len(wanted)
    assert all(bytes(r["payload"]) == wanted[r["page_id"]] for r in found if r["record_type"] == "response")
    path = archives.first()["path"]
    data = bytearray(get_bytes(path))
    data[100] ^= 0xFF
    hurt = f"{fresh_dir(spark, 'hurt')}/hurt.warc.gz"
    put_bytes(hurt, bytes(data))
    records, quarantine = warc.read_warc(archives.limit(1).withColumn("path", F.lit(hurt)))
    assert quarantine.count() == 1 and quarantine.first()["start"] == 0
    whole = len(list(warc.salvage(get_bytes(path))))
    assert records.count() == whole - 1
    assert zlib.crc32(bytes(data)) != zlib.crc32(get_bytes(path))
