"""WARC archives: a deduplicating writer and a splittable reader.

Writer: one gzip member a record. Of pages with equal payloads of at least ``least`` bytes,
that with the smallest page_id is written whole (response); the others refer to it
(revisit). Each task writes files of its own to a shared folder and returns their names
once they are whole, so a task that is run again leaves no record twice.

Reader: files are cut into byte ranges. A task looks for gzip magic from the start of its
range, takes a place as a record only if what it inflates to begins with a whole WARC
header, decodes members from there one after the other, and owns every record that starts
in its range; it reads on past the end for the last one. Headers may be of any length. The query
compares the number of records read with that written. The magic cannot be part of UTF-8
text, so an uncompressed block of a page is never taken for a record.

Null html is an empty payload, a null url an empty one. A row with a null page_id is always
a response. Repeated rows are records each, all responses if theirs is the smallest
page_id. Other columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, filesystem, new_path, saved, table

MAGIC = b"\x1f\x8b\x08"
#: WARC header names and profiles.
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
BLOCK = 1 << 20
ROLL = 64 << 20


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; the payload of a revisit is left out, its size and digest stay in the header."""
    key = b"null" if page_id is None else b"%d" % page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:" + key + b">",
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url or "").encode("utf-8", "replace"),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Payload-Length: %d" % size,
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files in a shared folder; returns the written manifest (file, bytes, records)."""
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    copies = saved(
        full.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "copies"
    )
    rows = full.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "size", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to")
    )

    def run(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name, out, size, records = None, None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([records])], ["file", "bytes", "records"])

        for b in batches:
            for page_id, url, payload, n, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                member = record(page_id, url, payload, n, digest, refers_to)
                out.write(member)
                size += len(member)
                records += 1
                if size >= ROLL:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return saved(bounded(rows).mapInArrow(run, "file string, bytes long, records long"), "manifest")


def header(data: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header and where its block starts; None if data does not begin with a whole one."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if {"warc-type", "content-length"} <= fields.keys() else None


class _Window:
    """A file read forward in blocks, from which what lies behind can be let go; going back reads anew."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, bytearray()
        file.seek(start)

    def at(self, pos: int, n: int) -> bytes:
        if pos < self.base:
            self.file.seek(pos)
            self.base, self.data = pos, bytearray()
        while self.base + len(self.data) < pos + n:
            more = self.file.read(BLOCK)
            if not more:
                break
            self.data += more
        return bytes(self.data[pos - self.base : pos - self.base + n])

    def free(self, pos: int) -> None:
        if pos - self.base > 2 * BLOCK:
            del self.data[: pos - self.base]
            self.base = pos


def _member(window: _Window, pos: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the record whose member starts at pos; None if none does. Holds the block, and of the file a few blocks."""
    inflate, data, found, at, looked = zlib.decompressobj(31), bytearray(), None, pos, 0
    try:
        while not inflate.eof:
            part = window.at(at, 1 << 16)
            if not part:
                return None
            data += inflate.decompress(part)
            at += len(part)
            if found is not None:
                window.free(at)
            elif inflate.eof or len(data) >= 2 * looked:  # a long header is not searched at every step
                looked = len(data)
                found = header(data)
                if found is None and (b"\r\n\r\n" in data or not data.startswith(b"WARC/1."[: len(data)])):
                    return None
    except zlib.error:
        return None
    if found is None:
        return None
    fields, start = found
    del data[start + int(fields["content-length"]) :]
    del data[:start]
    return fields, bytes(data), at - len(inflate.unused_data)


def scan(file, start: int, end: int):
    """(header fields, block) of each record whose member starts in [start, end)."""
    window, pos = _Window(file, start), start
    while pos < end:
        piece = window.at(pos, min(BLOCK, end - pos) + 2)
        hit = piece.find(MAGIC)
        if hit < 0:
            if len(piece) < 3:
                return
            pos += len(piece) - 2
            window.free(pos)
            continue
        pos += hit
        if pos >= end:
            return
        got = _member(window, pos)
        if got is None:
            pos += 1
            continue
        yield got[0], got[1]
        pos = got[2]
        window.free(pos)


def read(spark: SparkSession, folder: str, manifest: DataFrame, split: int = 4 << 20) -> DataFrame:
    """Records of the files in manifest (file, bytes): page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    ranges = manifest.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split))).alias("start"), "bytes")
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 100_000), "file", "start")
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def number(text: str | None):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    def run(batches):
        fs, at = filesystem(folder)
        for b in batches:
            for name, start, size in zip(*(c.to_pylist() for c in b.columns)):
                out, held = [[] for _ in names], 0
                with fs.open_input_file(f"{at}/{name}") as f:
                    for fields, block in scan(f, start, min(start + split, size)):
                        kind = fields["warc-type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = hashlib.sha256(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        length = len(payload) if payload is not None else int(fields.get("warc-payload-length", 0))
                        row = (number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, payload, length, digest, number(fields.get("warc-refers-to")))
                        for column, value in zip(out, row):
                            column.append(value)
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                            out, held = [[] for _ in names], 0
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return bounded(ranges).mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def counted(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records, written, if there are as many as the manifest (file, bytes, records) says; else an error."""
    out = saved(records, "records")
    got, want = out.count(), manifest.agg(F.sum("records")).first()[0] or 0
    if got != want:
        raise RuntimeError(f"read {got} records of {want} written")
    return out


def op5_warc(spark, sf_dir):
    folder = new_path(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return counted(read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), manifest)


#: The same rows from the pages themselves.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
