"""Operator 8: WARC records in seekable Zstandard bundles.

Each task groups its records into independent Zstandard frames, writes frames
into bundles, and ends each bundle with a seek table (a skippable frame holding
every frame's sizes, and a footer with their number), so any record is read by
one seek and one frame. The index maps a record's identifier to its bundle, its
frame, and its offset within the frame; where the frame lies is read from the
bundle's footer. The first frame holds the bundle's warcinfo record alone.

Of records with equal payloads of at least ``least_bytes`` bytes, the one of the
smallest page_id is a response and holds the payload; the others are revisit
records that name it by its record identifier. Digests are pre-aggregated; only payloads that occur under
several page_ids are looked up again, by broadcast if they are few, else by a
join; payloads never move.

Defined results: null html: an empty payload; null page_id: a revisit if another
page has the payload, else a response; repeated rows of one page_id: each gets a
record of the same type, under one identifier if the payloads agree; null url: urn:page:<page_id>; line breaks in a url are
percent-encoded; an empty table gives no bundle and no rows; extra columns are
ignored. One payload is held by one task; bundles are cut at BUNDLE_BYTES.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import files, store, vec

LEAST_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Repeated payloads that may be broadcast, at about 100 bytes each.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the seekable format: the seek table's skippable frame, and its footer.
SEEK_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, record_id string, bundle string, frame int, at int, size int"


def identifier(page_id: int | None, digest: str) -> str:
    """The record identifier of a page's payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def warcinfo(bundle: str, date: str = DATE) -> bytes:
    """The record that opens a bundle."""
    block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, bundle)}>",
        f"WARC-Date: {date}",
        f"WARC-Filename: {bundle.rsplit('/', 1)[-1]}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str, date: str = DATE) -> tuple[str, bytes]:
    """(identifier, bytes) of one WARC record."""
    name = identifier(page_id, digest)
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{identifier(refers_to, digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = _HTTP if kind == "revisit" else _HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its content")
    return headers, block.partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEK_FOOTER)
    return struct.pack("<II", SEEK_FRAME, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int]]:
    """(compressed, raw) sizes of the frames of an open bundle, read from its end."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_FOOTER:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * count)
    raw = f.read(8 * count)
    return [struct.unpack_from("<II", raw, 8 * i) for i in range(count)]


class _Bundler:
    """Frames and bundles of one task's records."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int) -> None:
        context = TaskContext.get()
        self.prefix = f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:8]}"
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3)
        self.number = 0
        self._new()

    def _new(self) -> None:
        self.path = f"{self.prefix}-{self.number:04d}.warc.zst"
        self.number += 1
        self.body: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.end = 0
        self.rows: list[tuple] = []
        self.raw: list[bytes] = []
        self.raw_size = 0
        self.waiting: list[tuple] = []

    def add(self, page_id, name: str, raw: bytes) -> None:
        if not self.frames:
            info = warcinfo(self.path)
            self._put(info, len(info))
        self.waiting.append((page_id, name, self.raw_size, len(raw)))
        self.raw.append(raw)
        self.raw_size += len(raw)
        if self.raw_size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.raw:
            return
        self.rows += [(p, n, self.path, len(self.frames), at, size) for p, n, at, size in self.waiting]
        self._put(b"".join(self.raw), self.raw_size)
        self.raw, self.raw_size, self.waiting = [], 0, []

    def _put(self, raw: bytes, size: int) -> None:
        frame = self.pack.compress(raw)
        self.frames.append((len(frame), size))
        self.body.append(frame)
        self.end += len(frame)

    def full(self) -> bool:
        return self.end >= self.bundle_bytes

    def close(self) -> pa.RecordBatch | None:
        """Writes the bundle; its index rows."""
        self._close_frame()
        if not self.frames:
            return None
        files.write(self.path, b"".join(self.body) + seek_table(self.frames))
        cols = list(zip(*self.rows))
        types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in INDEX.split(", ")])
        self._new()
        return out


def typed(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, first): first is the response's page_id where a row is a revisit, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= least_bytes)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = store.settled(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "repeated-payloads")
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    met = rows.join(several, "digest", "left")
    return met.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).select("page_id", "url", "html", "digest", "first")


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles below folder; the index, itself a table in the shared folder."""
    spark = pages.sparkSession
    folder = folder or store.fresh(spark, "warc")
    files.make_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]):
        out = _Bundler(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for part in vec.slices(batch, "html"):
                for page_id, url, html, digest, first in zip(*[c.to_pylist() for c in part.columns]):
                    name, raw = record(page_id, url, html.encode(), digest, first, "response" if first is None else "revisit")
                    out.add(page_id, name, raw)
                    if out.full():
                        yield out.close()
        last = out.close()
        if last is not None:
            yield last

    return store.settled(typed(pages, least_bytes).mapInArrow(vec.lean(run), INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every indexed record.

    Each frame is read once, where the bundle's seek table says that it lies. A
    record must have the index's identifier, a response's payload is digested again
    and must agree with its header, and a revisit must name the response's record.
    """

    def run(batches):
        path, frame, reader, raw, unpack, sizes, ends = None, None, None, b"", zstandard.ZstdDecompressor(), [], []
        for batch in batches:
            rows = []
            for page_id, record_id, bundle, number, at, size in zip(*[c.to_pylist() for c in batch.columns]):
                if bundle != path:
                    reader, path, frame = files.open_read(bundle), bundle, None
                    sizes = [packed for packed, _ in read_seek_table(reader)]
                    ends = list(accumulate(sizes))
                if number != frame:
                    reader.seek(ends[number] - sizes[number])
                    raw, frame = unpack.decompress(reader.read(sizes[number])), number
                headers, payload = parse(raw[at : at + size])
                if headers["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"the index names another record for page {page_id}")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = headers["WARC-Type"]
                length = int(headers["WARC-Payload-Length"])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                    raise ValueError(f"the payload of page {page_id} does not match its digest")
                refers = int(headers["WARC-Refers-To-Page-ID"]) if kind == "revisit" else None
                if kind == "revisit" and headers["WARC-Refers-To"] != f"<{identifier(refers, digest)}>":
                    raise ValueError(f"the revisit of page {page_id} names no response")
                held = headers["WARC-Page-ID"]
                rows.append((int(held) if held else None, headers["WARC-Target-URI"], payload if kind == "response" else None, length, digest, kind, refers))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.sparkSession.sparkContext.defaultParallelism)
    order = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    rows = order.select("page_id", "record_id", "bundle", "frame", "at", "size")
    return rows.mapInArrow(vec.lean(run), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the bundles back, and returns what they say."""
    return read_bundles(write_bundles(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
