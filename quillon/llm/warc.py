"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writing: a record is one gzip member; files roll at a bounded size and appear
whole in the shared folder.  Of records with equal payloads of at least
``REVISIT_BYTES`` bytes, the one with the smallest page_id is a response and
the others are revisits that refer to it.

Reading: every member and record is checked (gzip checksum, version line,
header lines, lengths, block and payload digests).  After a failed check the
reader searches for the nearest gzip member that begins with a version line or
version line in the clear, whatever the file held before, goes on from there,
and logs the bytes between as a quarantined gap.  Inside a member it searches
for the next version line, also in what a broken member gave before its error,
and logs the bad range of the inflated content.  In a broken member a record
needs a digest that holds; if only the checksum of the whole fails and every
record passes, the damage is in a header, which no digest covers, and the member
is quarantined.

Defined results: a null payload is an empty one; a null page_id sorts after all
others, so it is referred to only by equal payloads without identifiers; rows
that repeat the smallest page_id of a payload are each a response; a page_id with
several payloads has a record of each, and a revisit takes length and digest of
the payload that it repeats; a null url gives a record without target; urls and
payloads of any length stay whole; other columns, whatever their names, are
ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import mmap
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import TASK_BYTES, bounded, fresh_dir, get_bytes, local_path, put_bytes, table, written

REVISIT_BYTES = 100
#: A file ends with the record that reaches this size.
FILE_BYTES = 32 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a table entry takes when it is broadcast.
ENTRY_BYTES = 256
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PIECE = 1 << 16
_CHECKSUM, _LENGTH = "bad member: incorrect data check", "bad member: incorrect length check"


# Records


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP head and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# Salvage


class Damage(ValueError):
    """A failed check; ``end`` is where reading may go on, None if that is unknown."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def http(self) -> bool:
        return self.headers.get("content-type", "").startswith("application/http")

    @property
    def payload(self) -> bytes:
        head = self.block.find(b"\r\n\r\n") if self.http else -1
        return self.block[head + 4 :] if head >= 0 else self.block


@dataclass
class Gap:
    """Quarantined bytes; ``inner`` is their range in the inflated content if other records of the member are sound."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


def _known_digest(claim: str | None) -> bool:
    return (claim or "").partition(":")[0].lower().replace("-", "") in ("sha1", "sha256", "md5")


def _digest_fails(claim: str | None, data: bytes) -> bool:
    """True if a digest of a known kind, in hex or base32, doesn't hold."""
    if not _known_digest(claim):
        return False
    kind, _, value = claim.partition(":")
    made = hashlib.new(kind.lower().replace("-", ""), data).digest()
    return value.lower() != made.hex() and value.upper().rstrip("=") != base64.b32encode(made).decode().rstrip("=")


def parse(data: bytes | mmap.mmap, at: int) -> tuple[Record, int]:
    """The record at ``at`` and the position behind it; raises Damage."""
    start = _VERSION.match(data, at)
    if not start:
        raise Damage("no version line")
    headers: dict[str, str] = {}
    # Line by line, of any length: a header that doesn't end stops at the next version line, which has no colon.
    body = start.end()
    while True:
        stop = data.find(b"\r\n", body)
        if stop < 0:
            raise Damage("unfinished header")
        line, body = data[body:stop], stop + 2
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("bad header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise Damage("bad length")
    end = body + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("block ends elsewhere")
    found = Record(headers, bytes(data[body:end]))
    if _digest_fails(headers.get("warc-block-digest"), found.block):
        raise Damage("block digest differs", end + 4)
    if found.kind != "revisit" and _digest_fails(headers.get("warc-payload-digest"), found.payload):
        raise Damage("payload digest differs", end + 4)
    return found, end + 4


@dataclass
class Content:
    """What a gzip member holds; ``end`` is None if it breaks off, ``error`` None if it is whole."""

    body: bytes
    end: int | None
    error: str | None = None
    #: All content is there and its checksum holds, or it was only cut short: what is there is right.
    exact: bool = True
    #: Up to here a broken member was read; version lines before that may be its own, stored in the clear.
    read: int = 0
    #: Only the checksum tells of damage, not where it is.
    vague: bool = False


def _until_error(unpack: zlib._Decompress, piece: bytes) -> tuple[bytes, str, int]:
    """What ``piece`` inflates to before its error, the error, and the bytes read."""
    out, todo, used = [], [piece], 0
    while todo:
        piece = todo.pop()
        before = unpack.copy()
        try:
            out.append(unpack.decompress(piece))
            used += len(piece)
        except zlib.error as e:
            unpack = before
            if len(piece) > 1:
                todo += [piece[len(piece) // 2 :], piece[: len(piece) // 2]]
                continue
            with contextlib.suppress(zlib.error):
                while made := unpack.decompress(piece, 1):
                    out.append(made)
                    piece = unpack.unconsumed_tail
            return b"".join(out), str(e).partition(": ")[2] or str(e), used + 1
    return b"".join(out), "", used


def _inflate(data: bytes | mmap.mmap, at: int, stop: int | None = None) -> Content:
    """The content of the gzip member at ``at``, as far as it goes before ``stop``."""
    unpack, parts, now = zlib.decompressobj(31), [], at
    while not unpack.eof:
        piece = data[now : now + _PIECE if stop is None else min(now + _PIECE, stop)]
        if not piece:
            return Content(b"".join(parts), None, "unfinished member", read=now)
        before = unpack.copy() if now > at else zlib.decompressobj(31)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            made, error, used = _until_error(before, piece)
            error = f"bad member: {error}"
            return Content(b"".join([*parts, made]), None, error, error == _LENGTH, now + used, error == _CHECKSUM)
        now += len(piece)
    return Content(b"".join(parts), now - len(unpack.unused_data))


def _proven(found: Record) -> bool:
    """Whether a digest covers the block or the payload."""
    return _known_digest(found.headers.get("warc-block-digest")) or (found.kind != "revisit" and _known_digest(found.headers.get("warc-payload-digest")))


def _records(content: Content) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """Sound records of a member and the bad ranges (start, end, reason) of its content."""
    body, records, bad, inside = content.body, [], [], 0
    while inside < len(body):
        try:
            found, end = parse(body, inside)
            if not (content.exact or _proven(found)):
                raise Damage("no digest in a bad member", end)
        except Damage as e:
            end = e.end
            if end is None or (end < len(body) and not _VERSION.match(body, end)):
                ahead = _VERSION.search(body, inside + 1)
                end = ahead.start() if ahead else len(body)
            start, _, reason = bad.pop() if bad and bad[-1][1] == inside else (inside, inside, e.reason)
            bad.append((start, end, reason))
        else:
            records.append(found)
        inside = end
    if content.vague and not bad:
        return [], [(0, len(body), content.error)]
    if content.error and not content.vague:
        start = bad.pop()[0] if bad and bad[-1][1] == len(body) else len(body)
        bad.append((start, len(body), content.error))
    return records, bad


def _opens(data: bytes | mmap.mmap, at: int) -> bool:
    """Whether a gzip member with a version line seems to begin here."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 512], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(data: bytes | mmap.mmap, start: int) -> int:
    while (start := data.find(_MAGIC, start)) >= 0 and not _opens(data, start):
        start += 1
    return len(data) if start < 0 else start


def _version(data: bytes | mmap.mmap, start: int) -> int:
    found = _VERSION.search(data, start)
    return found.start() if found else len(data)


def salvage(data: bytes | mmap.mmap) -> Iterator[tuple[int, int, Record] | Gap]:
    """(start, end, record) of all sound records, and a Gap for what lies between them.

    Records and gaps of one member share its bytes.
    """
    at, size = 0, len(data)
    #: Of each kind of start the nearest one found, and where that search began.
    ahead = {_member: (0, -1), _version: (0, -1)}

    def next_start(start: int, clear: int | None = None) -> int:
        """The nearest member that opens with a version line, or version line in the clear from ``clear`` on."""
        for find, low in ((_member, start), (_version, start if clear is None else clear)):
            if not ahead[find][0] <= low <= ahead[find][1]:
                ahead[find] = low, find(data, low)
        return min(found for _, found in ahead.values())

    bad, why = None, ""
    while at < size:
        ranges: list[tuple[int, int, str]] = []
        try:
            if data[at : at + 3] == _MAGIC:
                content = _inflate(data, at)
                end = content.end
                if end is None:
                    end = next_start(at + 1, content.read)
                    if end < content.read:
                        # It was read on into the next member.
                        content = replace(_inflate(data, at, end), error=content.error, exact=False)
                records, ranges = _records(content)
                if ranges and not records:
                    if bad is None:
                        bad, why = at, content.error or ranges[0][2]
                    at = end
                    continue
            else:
                found, end = parse(data, at)
                records = [found]
        except Damage as e:
            if bad is None:
                bad, why = at, e.reason
            at = e.end if e.end is not None and (e.end == size or e.end == next_start(e.end)) else next_start(at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        for found in records:
            yield at, end, found
        for start, stop, reason in ranges:
            yield Gap(at, end, reason, (start, stop))
        at = end
    if bad is not None:
        yield Gap(bad, size, why)


def open_archive(uri: str) -> bytes | mmap.mmap:
    """The bytes of an archive; files on a mounted path are mapped, not read into memory."""
    path = local_path(uri)
    if path is None:
        return get_bytes(uri)
    with open(path, "rb") as file:
        file.seek(0, 2)
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if file.tell() else b""


# Spark


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, first_id, revisit) of every row.

    Digests alone are shuffled; payloads stay where they are while the digests
    that occur more than once are few enough to broadcast.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = F.struct(F.col("page_id").isNull().alias("missing"), F.col("page_id").alias("id"))
    groups = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .select("digest", first.alias("first"))
        .groupBy("digest")
        .agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    groups = bounded(written(groups.select("digest", F.col("first.id").alias("first_id"), F.lit(True).alias("grouped")), "payloads"), ENTRY_BYTES)
    revisit = F.coalesce("grouped", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "first_id", revisit.alias("revisit"))


def write_warc(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``root``; returns (path, records, bytes)."""
    root = root or fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            path = f"{root}/part-{part:06d}-{number:05d}.warc.gz"
            put_bytes(path, b"".join(held))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [size]})
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, first_id, revisit = (c[k].as_py() for c in columns)
                held.append(member(record(page_id, url, payload, digest, first_id, revisit)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return written(mark_revisits(pages).mapInArrow(run, "path string, records long, bytes long"), "archives")


_SCAN = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("gap", pa.string()),
        ("inner_start", pa.int64()),
        ("inner_stop", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("claim", pa.string()),
        ("payload", pa.binary()),
    ]
)
_SCAN_SCHEMA = (
    "path string, start long, stop long, gap string, inner_start long, inner_stop long, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_bytes long, payload_digest string, claim string, payload binary"
)
_BATCH_ROWS, _BATCH_BYTES = 2000, 16 << 20


def scan(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of the archives in column ``path``; rows with a ``gap`` reason are quarantined bytes.

    Length and digest are of the payload as it was read (null for revisits,
    which have none), ``claim`` is the payload digest of the header in lower
    case; ``payloads`` asks for the bytes too.
    """
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "bytes" in archives.columns:
        tasks = max(tasks, -(-(archives.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))

    def rows(path: str) -> Iterator[dict]:
        for found in salvage(open_archive(path)):
            if isinstance(found, Gap):
                inner = found.inner or (None, None)
                yield {"path": path, "start": found.start, "stop": found.end, "gap": found.reason, "inner_start": inner[0], "inner_stop": inner[1]}
                continue
            start, stop, r = found
            row = {"path": path, "start": start, "stop": stop, "record_type": r.kind, "record_id": r.headers.get("warc-record-id")}
            row |= {"refers_to": r.headers.get("warc-refers-to"), "target_uri": r.headers.get("warc-target-uri")}
            if claim := r.headers.get("warc-payload-digest"):
                row["claim"] = claim.lower()
            if r.kind != "revisit":
                body = r.payload
                row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body if payloads else None}
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row.get("payload") or b"") + len(row.get("target_uri") or "")
                    if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _SCAN)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _SCAN)

    return archives.select("path").repartition(tasks, "path").mapInArrow(run, _SCAN_SCHEMA)


def read_warc(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of the archives.

    Revisits take length and digest of the response that they refer to.  If
    several responses have that identifier, it is the one whose header names the
    revisit's payload digest; a revisit without a digest takes that of an
    identifier with a single payload.  A revisit whose response isn't there has
    neither length nor digest.
    """
    found = written(scan(archives).drop("payload"), "scan")
    quarantine = found.where("gap IS NOT NULL").select("path", "start", "stop", F.col("gap").alias("reason"), "inner_start", "inner_stop")
    records = found.where("gap IS NULL").drop("gap", "inner_start", "inner_stop")
    wanted = records.where("record_type = 'revisit'").select("refers_to").distinct()
    response = records.where("record_type = 'response'").select("record_id", "claim", "payload_bytes", "payload_digest")
    response = response.join(wanted, response["record_id"] == wanted["refers_to"], "left_semi")
    # Records with one identifier may repeat, with equal payloads or with different ones.
    of = F.struct("payload_digest", "payload_bytes")
    key, none = F.col("record_id").alias("response_id"), F.lit("")
    claimed = response.where("claim IS NOT NULL").groupBy(key, F.col("claim").alias("response_claim")).agg(F.min(of).alias("of"))
    single = response.groupBy(key).agg(F.min(of).alias("of"), F.max(of).alias("last")).where("of = last")
    response = claimed.unionByName(single.select("response_id", none.alias("response_claim"), "of"))
    response = bounded(written(response, "responses"), ENTRY_BYTES)
    same = (records["refers_to"] == response["response_id"]) & (F.coalesce(records["claim"], none) == response["response_claim"])
    joined = records.join(response, same, "left")
    columns = ["path", "start", "stop", "record_type", "record_id", "refers_to", "target_uri"]
    sizes = [F.coalesce(n, f"of.{n}").alias(n) for n in ("payload_bytes", "payload_digest")]
    return joined.select(*columns, *sizes), quarantine


def page_of(column: str) -> F.Column:
    """The page_id inside a record's identifier; null where there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1), '') AS long)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = read_warc(write_warc(table(spark, sf_dir, "pages")))
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )


QUERIES = {"op1_warc": query}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
}
