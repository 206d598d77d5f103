"""WARC archives: writing with revisit records, and a reader that salvages damaged ones.

A record is one gzip member: the version line, headers, a blank line, ``Content-Length`` bytes and two
line ends. The reader walks from record to record. Where a check fails (member, version line,
headers, length, block digest) it looks for the next place at which a whole
record passes all checks, a gzip member or a bare version line, goes on from there, and logs the
bytes in between as a gap. Within a sound member of several records it looks for the next version line in the
content; such a gap has the member's place, and its bytes of the content in the reason. Nothing is guessed: a record is returned only if all its checks pass.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.files import Opened, Rolling
from loomdex.llm.skew import look_up
from loomdex.runtime import new_path, stash

LOG = logging.getLogger(__name__)
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
LINE = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
ARCHIVE_BYTES = 32 << 20
WINDOW = 1 << 14


@dataclass(frozen=True)
class Record:
    offset: int
    length: int  # stored bytes
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Quarantined bytes: from, to, and the check that failed."""

    start: int
    end: int
    reason: str


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(kind: str, headers: dict[str, str], block: bytes, packed: bool = True) -> bytes:
    """One record; header values hold no line ends."""
    lines = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{digest32(block)}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in lines.items())
    raw = VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    if not packed:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the bare record at ``at``; ValueError names the check that failed."""
    if not raw.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n"), at):
        raise ValueError("version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers")
    headers = {}
    for line in raw[at + 10 : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("headers")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("content length")
    start, stop = end + 4, end + 4 + int(length)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = raw[start:stop]
    named = headers.get("warc-block-digest")
    if named and named.lower().startswith("sha1:") and named[5:].upper() != digest32(block):
        raise ValueError("block digest")
    return headers, block, stop + 4


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its CRC and length are checked."""
    z = zlib.decompressobj(31)
    view, out, here = memoryview(data), [], at
    try:
        while not z.eof and here < len(data):
            out.append(z.decompress(view[here : here + WINDOW]))
            here += WINDOW
    except zlib.error as e:
        raise ValueError("gzip member") from e
    if not z.eof:
        raise ValueError("truncated member")
    return b"".join(out), min(here, len(data)) - len(z.unused_data)


def _parses(raw: bytes, at: int) -> bool:
    try:
        parse(raw, at)
    except ValueError:
        return False
    return True


def record_at(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records of the member with the gaps in its content, or the bare record, at ``at``, and where they end."""
    if data.startswith(MAGIC, at):
        raw, end = member(data, at)
        found, inner, first = [], 0, None
        while inner < len(raw):
            try:
                headers, block, inner = parse(raw, inner)
            except ValueError as e:
                start, first = inner, first or e
                inner = next((m.start() for m in LINE.finditer(raw, start + 1) if _parses(raw, m.start())), len(raw))
                found.append(Gap(at, end, f"{e}, bytes {start} to {inner} of the member's content"))
            else:
                found.append(Record(at, end - at, headers, block))
        if first and not any(isinstance(x, Record) for x in found):
            raise first
        return found, end
    headers, block, end = parse(data, at)
    return [Record(at, end - at, headers, block)], end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks and the gaps between them, in order."""
    at = 0
    while at < len(data):
        try:
            found, end = record_at(data, at)
        except ValueError as e:
            start, reason = at, str(e)
            at = len(data)
            for m in NEXT.finditer(data, start + 1):
                try:
                    record_at(data, m.start())
                except ValueError:
                    continue
                at = m.start()
                break
            yield Gap(start, at, reason)
        else:
            yield from found
            at = end


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives named in column ``name``.

    kind (record or gap), name, start, end, reason, headers, block. An empty table gives an empty result.
    """
    schema = "kind string, name string, start long, end long, reason string, headers map<string,string>, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Opened(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                for x in salvage(files.whole(name)):
                    if isinstance(x, Gap):
                        rows.append(("gap", name, x.start, x.end, x.reason, None, None))
                    else:
                        rows.append(("record", name, x.offset, x.offset + x.length, None, list(x.headers.items()), x.block))
                        size += len(x.block)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    # an archive is one task's work, whatever number of archives a writer made
    return archives.select("name").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    names = ["kind", "name", "start", "end", "reason", "headers", "block"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def base32_of(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four symbols of five bits for every five digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with payload_bytes, hexed (SHA-1) and refers_to (null: response).

    Of equal payloads the smallest page_id is the response; rows that share that page_id are
    responses all. Null ids refer to the smallest of their payload, if there is one.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("hexed"))
    groups = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("hexed").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    owners = stash(groups.where("n > 1"), "owners")
    # payloads that many pages share are looked up where they are; other payloads move only if their owners are too many to broadcast
    return look_up(keyed, owners.drop("n"), "hexed", owners, "left").select(
        "page_id", "url", "payload_bytes", "hexed",
        F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"),
        F.when(F.col("page_id").eqNullSafe(F.col("least")) | F.col("least").isNull(), F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of (page_id, url, html) in ``folder``; returns name and records of each, stashed.

    Null html is an empty payload, a null url an empty one. Revisits name their response's page and the payload's
    digest and length, and have no block.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    roles = with_roles(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made = Rolling(folder, ".warc.gz", archive_bytes), {}
        for b in batches:
            for row in zip(*b.columns):
                page, url, size, hexed, refers, payload = (x.as_py() for x in row)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                own = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page}"))
                headers = {
                    "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url or "",
                    "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/html; charset=utf-8",
                    "X-Payload-Bytes": str(size),
                }
                if page is not None:
                    headers["X-Page-Id"] = quote(str(page), safe="")
                if refers is None:
                    name, _ = out.put(encode("response", headers, (payload or "").encode()))
                else:
                    headers["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers}')}>"
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    headers["X-Refers-To-Page"] = quote(str(refers), safe="")
                    name, _ = out.put(encode("revisit", headers, b""))
                made[name] = made.get(name, 0) + 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], names=["name", "records"])

    rows = roles.select(F.col("page_id").cast(kind), "url", "payload_bytes", "hexed", "refers_to", "payload")
    return stash(rows.mapInArrow(run, "name string, records long"), "archives")


class Lost(RuntimeError):
    """Archives that were just written do not give back what went in."""


def log_gaps(read: DataFrame, most: int = 100) -> int:
    """Number of the gaps among ``read`` records and gaps; the first ``most`` are logged, all of them stay rows of ``read``."""
    gaps = read.where("kind = 'gap'").select("name", "start", "end", "reason")
    n = gaps.count()
    for r in gaps.orderBy("name", "start").limit(most).collect() if n else ():
        LOG.warning("%s: bytes %d to %d quarantined: %s", r["name"], r["start"], r["end"], r["reason"])
    return n


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    A gap in the archives, or fewer records than were written, raises ``Lost``. Extra columns are ignored, repeated rows
    have a record each, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = new_path(spark, "warc")
    return pages_of(write_archives(pages, folder, least_bytes, archive_bytes), folder, kind)


def pages_of(archives: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """What ``round_trip`` returns, of the archives (name, records) in ``folder``."""
    sizes = archives.agg(F.count("*").alias("names"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    got = read_archives(archives.select("name").repartition(max(1, min(sizes["names"], 100_000)), "name"), folder)
    h = F.col("headers")
    response = h["warc-type"] == "response"
    read = stash(
        got.select(
            "kind", "name", "start", "end", "reason",
            F.url_decode(h["x-page-id"]).cast(kind).alias("page_id"),
            F.when(response, F.octet_length("block")).otherwise(h["x-payload-bytes"].cast("long")).cast("long").alias("payload_bytes"),
            F.when(response, base32_of(F.sha1("block"))).otherwise(F.substring(h["warc-payload-digest"], 6, 32)).alias("payload_digest"),
            h["warc-type"].alias("record_type"),
            F.url_decode(h["x-refers-to-page"]).cast(kind).alias("refers_to"),
        ),
        "read",
    )
    gaps, records = log_gaps(read), read.where("kind = 'record'").count()
    if gaps or records != sizes["records"]:
        raise Lost(f"{records} of {sizes['records']} records and {gaps} gaps in {folder}")
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(flatten(list_transform(range(8), lambda i: list_transform([32768, 1024, 32, 1],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) // s) % 32, 1)))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM d
"""
