"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed one by one; a seek table in a skippable frame at the end gives the size of each, and
an index gives every record's frame and its offset there. A bundle is one row of a written table, so Spark's committer makes it appear
whole or not at all, and any store that Spark writes will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import BROADCAST_IDS, mapped, table, text_or_empty, written

#: Bytes before compression after which a frame, and a bundle, is closed.
FRAME, BUNDLE = 1 << 18, 1 << 24
#: Fixed values of the seekable format: a skippable frame's magic number, the footer's, and the footer's length.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str = "") -> str:
    """Identifier of a page's record; a page without an id goes by its payload."""
    name = f"page:{page_id}" if page_id is not None else f"payload:{digest}"
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Identifier and bytes of one WARC/1.1 record: the response, or a revisit of the response of page `refers_to`."""
    digest = sha1_base32(payload)
    name = record_id(page_id, digest)
    block = _HTTP if refers_to is not None else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>", f"Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; the payload of a response is what follows the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Collects records into frames; `close` gives the bundle and where each record is."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.open_frame()
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.raw = 0

    def open_frame(self) -> None:
        self.parts, self.at = [], 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), self.at, len(data)))
        self.parts.append(data)
        self.at += len(data)
        self.raw += len(data)
        if self.at >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.parts:
            frame = self.compressor.compress(b"".join(self.parts))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.at))
            self.open_frame()

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        tail = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + tail, self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the end of the bundle alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-FOOTER:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, len(bundle) - FOOTER - 8 * (n - k))
        entries.append((at, packed, size))
        at += packed
    return entries


ARCHIVE = "bundle string, content binary, record_ids array<string>, frames array<int>, offsets array<int>, sizes array<int>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, refers_to) to bundles."""
    part, number, writer = TaskContext.get().partitionId(), 0, BundleWriter()

    def closed() -> pa.RecordBatch:
        content, index = writer.close()
        names, frames, offsets, sizes = zip(*index, strict=True)
        lists = [pa.array([names], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.int32())) for x in (frames, offsets, sizes))]
        columns = ["bundle", "content", "record_ids", "frames", "offsets", "sizes"]
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([content], pa.binary()), *lists], names=columns)

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
            writer.add(*record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
            if writer.raw >= BUNDLE:
                yield closed()
                number, writer = number + 1, BundleWriter()
    if writer.index:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles to one row per record, by way of the index and the seek table."""
    whole = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            bundle, frames, opened, data = row["content"], seek_table(row["content"]), -1, b""
            out: dict[str, list] = {n: [] for n in ("record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            for name, frame, offset, size in zip(row["record_ids"], row["frames"], row["offsets"], row["sizes"], strict=True):
                if frame != opened:
                    place, packed, full = frames[frame]
                    opened, data = frame, whole.decompress(bundle[place : place + packed], max_output_size=full)
                fields, payload = parsed(data[offset : offset + size])
                if fields["WARC-Record-ID"] != f"<{name}>":
                    raise ValueError(f"{name} is not where the index says")
                response = fields["WARC-Type"] == "response"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if response and (digest != sha1_base32(payload) or len(payload) != int(fields["Payload-Length"])):
                    raise ValueError(f"payload of {name} does not fit its digest")
                out["record_id"].append(name)
                out["page_id"].append(int(fields["Page-ID"]) if "Page-ID" in fields else None)
                out["url"].append(fields.get("WARC-Target-URI"))
                out["payload_bytes"].append(int(fields["Payload-Length"]))
                out["payload_digest"].append(digest)
                out["record_type"].append(fields["WARC-Type"])
                out["refers_to"].append(None if response else int(fields["Refers-To-Page-ID"]))
                out["payload"].append(payload if response else None)
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def archived(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The written table of bundles of all pages.

    Of pages with equal payloads of `least` bytes or more the largest id becomes a response, the others revisit it; smaller payloads are
    all responses. Payloads are told apart by SHA-256. Null html is an empty payload, a null url is left out. Pages that repeat the largest
    id are responses too; a null id revisits if another page of its payload has an id, and else is a response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    keyed = rows.withColumn("payload_key", F.unhex(F.sha2("html", 256))).withColumn("bytes", F.octet_length("html"))
    groups = keyed.where(F.col("bytes") >= least).groupBy("payload_key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("payload_key").alias("group_key"), "first_id"), "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS // 10 else groups
    joined = keyed.join(groups, (keyed["payload_key"] == groups["group_key"]) & (F.col("bytes") >= least), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return written(mapped(joined.select("page_id", "url", "html", refers.alias("refers_to")), _write, ARCHIVE), "warc-bundles")


def records(archive: DataFrame) -> DataFrame:
    """All records of a table of bundles: record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return mapped(archive, _read, schema)


def fetched(archive: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records whose identifiers are in `record_ids` (one column): only the frames that hold one are decompressed."""
    index = archive.select("bundle", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "sizes")).alias("r")).select("bundle", "r.*")
    wanted = index.join(record_ids.toDF("wanted_id").distinct(), F.col("record_ids") == F.col("wanted_id"), "left_semi")
    # At most the records of one bundle, whose size is bounded, come together here.
    lists = wanted.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frames", "offsets", "sizes", "record_ids"))).alias("at"))
    lists = lists.select(F.col("bundle").alias("of_bundle"), "at")
    picked = archive.select("bundle", "content").join(lists, F.col("bundle") == F.col("of_bundle"))
    return records(picked.select("bundle", "content", *[F.col(f"at.{c}").alias(c) for c in ("record_ids", "frames", "offsets", "sizes")]))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records(archived(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), d AS (
  SELECT *, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * k + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::BIGINT, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
