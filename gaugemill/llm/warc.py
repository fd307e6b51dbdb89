"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, and at its end the
seek table of the seekable format: a skippable frame with one (compressed, uncompressed) size pair per
frame and a nine-byte footer. The index maps a record id to its bundle, frame and frame-relative offset,
so one record costs one range read and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, join_groups, settle, table

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame int, offset int, length int"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record_bytes(record_id: str, url: str | None, payload: bytes | None, digest: str, payload_bytes: int, refers_to: str | None, date: str) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The reverse of ``record_bytes``; the digest and size of a response are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = field["warc-type"]
    said = field["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != said or len(payload) != size:
            raise ValueError(f"{field['warc-record-id']}: payload does not match its digest")
    refers = field.get("warc-refers-to")
    return {
        "record_id": field["warc-record-id"][1:-1], "record_type": kind, "target_uri": field.get("warc-target-uri"), "refers_to": refers and refers[1:-1],
        "payload_bytes": size, "payload_digest": said, "payload": payload if kind == "response" else None,
    }


class Bundle:
    """Gathers records into frames; ``close`` returns the file's bytes and the index rows."""

    def __init__(self, level: int):
        import zstandard

        self.zstd, self.frames, self.sizes, self.open, self.open_bytes, self.bytes, self.index = zstandard.ZstdCompressor(level=level), [], [], [], 0, 0, []

    def add(self, record_id: str, raw: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.open_bytes, len(raw)))
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed) of each frame, from the end of an open random-access file."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - n * width)
    entries, out, at = file.read(n * width), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(rows: DataFrame, path: str, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``rows`` (record_id, url, payload, digest in hex, payload_bytes, refers_to) as bundles under
    ``path``, a folder that all executors reach, and returns the index, materialised.

    A bundle's name comes from its partition and content and appears by one rename, so a repeated
    task writes the same file again. A record of 4 GiB or more does not fit the format and raises.
    """

    def write(batches):
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(path)
        to.create_dir(root, recursive=True)
        part, bundle = TaskContext.get().partitionId(), Bundle(level)

        def ended(b):
            data = b.close()
            name = f"{root}/bundle-{part:06d}-{zlib.crc32(data):08x}-{len(data)}.warc.zst"
            with to.open_output_stream(tmp := f"{root}/.{uuid.uuid4().hex}") as out:
                out.write(data)
            to.move(tmp, name)
            ids, frames, offsets, lengths = zip(*b.index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int32()), pa.array(lengths, pa.int32())], names=["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for rid, url, payload, digest, size, refers in zip(*(batch.column(c) for c in ("record_id", "url", "payload", "digest", "payload_bytes", "refers_to")), strict=True):
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                bundle.add(rid.as_py(), record_bytes(rid.as_py(), url.as_py(), payload.as_py(), name, size.as_py(), refers.as_py(), date))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield ended(bundle)
                    bundle = Bundle(level)
        if bundle.index:
            yield ended(bundle)

    return settle(rows.mapInArrow(write, INDEX))


def read_records(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names, each cut out of its frame at its offset and parsed."""

    def read(t):
        import zstandard
        from pyarrow import fs

        there, _ = fs.FileSystem.from_uri(path)
        out: dict[str, list] = {c.split()[0]: [] for c in RECORD.split(", ")}
        t = t.sort_by([("frame", "ascending"), ("offset", "ascending")])
        with there.open_input_file(t["bundle"][0].as_py()) as file:
            frames, at, plain = seek_table(file), -1, b""
            for frame, offset, length in zip(*(t[c].to_pylist() for c in ("frame", "offset", "length")), strict=True):
                if frame != at:
                    start, packed, size = frames[frame]
                    file.seek(start)
                    plain, at = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size), frame
                record = parse_record(plain[offset : offset + length])
                if not with_payload:
                    record["payload"] = None
                for k, v in record.items():
                    out[k].append(v)
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    # The index is small beside the bundles: tasks are as many as bundles, not as its bytes would have it.
    bundles = max(1, index.agg(F.countDistinct("bundle")).first()[0])
    return index.repartition(bundles, "bundle").groupBy("bundle").applyInArrow(read, RECORD)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """What ``write_bundles`` takes: of equal payloads of at least ``least_bytes`` bytes the row with the
    largest id is the response, the others refer to it.

    Null html is the empty payload. A null id is smaller than any; rows that repeat both the winning
    id and the payload are all responses. A third of all rows may share one payload: their
    digest comes to where they are read, and a copy's payload goes no further.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    winners = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest")).groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    winners = settle(winners)
    total = winners.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    response = F.col("id").eqNullSafe(F.col("winner")) | (F.col("payload_bytes") < least_bytes)
    return join_groups(rows, winners, "digest", "copies", total).select(
        name("id").alias("record_id"), "url", F.when(response, F.col("payload")).alias("payload"), "digest", "payload_bytes", F.when(~response, name("winner")).alias("refers_to")
    )


def op10_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    index = write_bundles(plan_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")
    return read_records(index, path, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


QUERIES = {"op10_warc": op10_warc}
SQL = {
    "op10_warc": """SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(b), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
      CASE WHEN page_id = w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> w THEN w END AS refers_to
      FROM (SELECT page_id, b, max(page_id) OVER (PARTITION BY b) AS w FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages))"""
}
