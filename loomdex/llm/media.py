"""Media columns: content-defined chunks, deduplicated by joins, and lists that rebuild the media.

A payload is stored as an 8-bit mono WAV. A rolling gear hash cuts it where the hash of the
last 32 bytes ends a chunk, so equal passages give equal chunks wherever they stand. Chunks go
to pack files in the shared folder; what a task has stored already it doesn't store again. A
join on digests then gives each digest one address for the whole table, whoever stored it, and
each media the ordered list of its chunks' addresses. Media are rebuilt from those lists, once for every distinct
payload, and every chunk, the media and the payload are verified against their digests. Only addresses
are shuffled, never payloads.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.files import Opened, Rolling
from loomdex.llm.skew import look_up
from loomdex.runtime import new_path, stash

UNIT = 576
PAD = b"\xff"
LEAST, MASK_BITS, MOST = 2048, 13, 65536
PACK_BYTES = 64 << 20
REGION = 4 << 20
#: Digests a task remembers, so as not to store their chunks twice.
REMEMBER = 200_000
BLOCK = 1 << 20
ADDRESS = "struct<digest:binary,name:string,offset:long,stored:int,raw:int>"


def gear(seed: bytes = b"gear") -> np.ndarray:
    """A 32-bit number for each byte, from SHA-256 of the seed and the byte."""
    return np.array([int.from_bytes(hashlib.sha256(seed + bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = gear()


def border_hashes(data: bytes) -> np.ndarray:
    """Gear hash after each byte: sum of the last 32 bytes' numbers, shifted by their age, modulo 2**32.

    Five doublings of the window; the same values as the rolling form h = 2 * h + gear[byte].
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def borders(data: bytes) -> np.ndarray:
    """Ends of possible chunks: where the hash's high MASK_BITS bits are zero."""
    found = []
    for a in range(0, len(data), BLOCK):
        lead = min(a, 31)
        h = border_hashes(data[a - lead : a + BLOCK])[lead:]
        found.append(np.nonzero(h >> np.uint32(32 - MASK_BITS) == 0)[0] + a + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: bytes) -> list[int]:
    """Chunk ends; chunks have LEAST to MOST bytes, the last one may be shorter."""
    ends, at, possible = [], 0, borders(data)
    while len(data) - at > LEAST:
        i = int(np.searchsorted(possible, at + LEAST))
        end = int(possible[i]) if i < len(possible) else len(data)
        at = min(end, at + MOST, len(data))
        ends.append(at)
    if at < len(data) or not ends:
        ends.append(len(data))
    return ends


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 text padded with bytes 255 to a positive multiple of UNIT."""
    text = text or b""
    return text + PAD * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack("<I", media[40:44])[0] != len(media) - 44:
        raise ValueError("not one of these WAV files")
    return media[44:]


def features(samples: bytes) -> str:
    """Mean and deviation of samples around 128, and crossings of the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"mean={x.mean():.4f};deviation={x.std():.4f};crossings={crossings};samples={len(x)}"


class Remembered(dict):
    """The last ``limit`` keys put in."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def add(self, key, value) -> None:
        if len(self) >= self.limit:
            del self[next(iter(self))]
        self[key] = value


def store(documents: DataFrame, folder: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_bytes, payload (SHA-256), media (SHA-256) and chunks; null chunks: the task stored this payload before."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, zip_ = Rolling(folder, ".pack", pack_bytes), zstandard.ZstdCompressor(3)
        chunk_at, media_of = Remembered(REMEMBER), Remembered(REMEMBER)
        for b in batches:
            sizes, payloads, medias, lists = [], [], [], []
            for x in b.column(1):
                text = x.as_py() or b""
                payload = payload_of(text)
                key = hashlib.sha256(payload).digest()
                chunks = None
                if key not in media_of:
                    media = to_wav(payload)
                    media_of.add(key, hashlib.sha256(media).digest())
                    chunks, a = [], 0
                    for e in cuts(media):
                        part = media[a:e]
                        digest = hashlib.sha256(part).digest()
                        if digest not in chunk_at:
                            packed = zip_.compress(part)
                            chunk_at.add(digest, (*out.put(packed), len(packed), len(part)))
                        chunks.append(dict(zip(("digest", "name", "offset", "stored", "raw"), (digest, *chunk_at[digest]))))
                        a = e
                sizes.append(len(text))
                payloads.append(key)
                medias.append(media_of[key])
                lists.append(chunks)
            entry = pa.struct([("digest", pa.binary()), ("name", pa.string()), ("offset", pa.int64()), ("stored", pa.int32()), ("raw", pa.int32())])
            cols = [pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(medias, pa.binary()), pa.array(lists, pa.list_(entry))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "payload", "media", "chunks"])
        out.close()

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("t"))
    return stash(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload binary, media binary, chunks array<{ADDRESS}>"), "stored")


def resolve(stored: DataFrame) -> DataFrame:
    """payload, media and the ordered addresses of its chunks, for every distinct payload; one address for each digest."""
    full = stored.where("chunks is not null")
    media = stash(
        full.groupBy("payload").agg(F.min("media").alias("media"), F.min(F.transform("chunks", lambda c: c["digest"])).alias("digests")), "media"
    )
    every = full.select(F.explode("chunks").alias("c")).select("c.*")
    addresses = stash(every.groupBy("digest").agg(F.min(F.struct("name", "offset", "stored", "raw")).alias("address"), F.count("*").alias("n")), "addresses")
    listed = media.select("payload", "media", F.posexplode("digests").alias("seq", "digest"))
    found = look_up(listed, addresses.drop("n"), "digest", addresses).select("payload", "media", F.struct("seq", "address.*", "digest").alias("c"))
    return found.groupBy("payload", "media").agg(F.array_sort(F.collect_list("c")).alias("chunks"))


def rebuild(lists: DataFrame, folder: str) -> DataFrame:
    """Read, verify and describe every distinct payload; a chunk, media or payload that fails its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, unzip = Opened(folder), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for row in zip(*b.columns):
                key, media_key, chunks = (x.as_py() for x in row)
                parts = []
                for c in chunks:
                    part = unzip.decompress(files.read(c["name"], c["offset"], c["stored"]), max_output_size=c["raw"])
                    if hashlib.sha256(part).digest() != c["digest"]:
                        raise ValueError(f"chunk at {c['name']}+{c['offset']} fails its digest")
                    parts.append(part)
                media = b"".join(parts)
                if hashlib.sha256(media).digest() != media_key:
                    raise ValueError("media fails its digest")
                payload = from_wav(media)
                digest = hashlib.sha256(payload).digest()
                if digest != key:
                    raise ValueError("payload fails its digest")
                out.append((key, len(payload), digest.hex(), zlib.crc32(payload[-32:]), len(media), media_key.hex(), features(payload)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    # neighbours in a pack are read by one task
    first = F.col("chunks")[0]
    near = lists.repartition(first["name"], F.floor(first["offset"] / REGION))
    return near.select("payload", "media", "chunks").mapInArrow(
        run, "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def media_columns(documents: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every document.

    Null and empty texts have a payload of UNIT padding bytes. Repeated rows each return a row, extra columns
    are ignored, an empty table gives an empty result.
    """
    folder = new_path(documents.sparkSession, "packs")
    stored = store(documents, folder, pack_bytes)
    rebuilt = stash(rebuild(resolve(stored), folder), "rebuilt")
    return look_up(stored.select("doc_id", "n_bytes", "payload"), rebuilt, "payload").drop("payload")
