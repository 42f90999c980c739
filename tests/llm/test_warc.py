import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import warc

PAGES = [(1, "http://a/ b", "x" * 200), (2, None, "x" * 200), (3, "http://ä", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\x1f\u008b\x08 ünïcödé " * 30), (None, "u", "x" * 200), (8, "u", "y" * 99), (9, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (1, "u", "x" * 200), (12, "u", "w" * 3_000_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "payload", "first_id", "n", "refers_to")})


def expected(rows):
    out, first = [], {}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in data:
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    for i, b in data:
        revisit = i is not None and len(b) >= 100 and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [50, 1000, 4 << 20])
def test_round_trip(spark, tmp_path, split):
    rows = PAGES if split > 50 else PAGES[:-1]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, rows), folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(spark, folder, manifest, split)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(rows)
    bodies = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert bodies[7] == PAGES[6][2] and bodies[3] == "" and (split == 50 or bodies[12] == PAGES[-1][2])


def test_files_are_gzip_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark), folder).collect()
    text = b"".join(gzip.decompress((tmp_path / "w" / m.file).read_bytes()) for m in manifest)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_false_magic_and_torn_ranges():
    r = random.Random(5)
    records = [warc.record(i, "u", r.randbytes(r.randrange(5000)), 0, "d", None) for i in range(60)]
    junk = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a warc record")
    data = junk + b"".join(records)
    for step in (1, 97, 1000, 10**7):
        seen = []
        for start in range(0, len(data), step) if step > 1 else range(0, 3000):
            seen += [f["warc-record-id"] for f, _ in warc.scan(io.BytesIO(data), start, min(start + step, len(data)))]
        assert seen == [f"<urn:page:{i}>" for i in range(len(seen))] and (step == 1 or len(seen) == 60)


def test_unfinished_last_member():
    data = b"".join(warc.record(i, "u", b"abc" * 100, 300, "d", None) for i in range(3))
    assert len(list(warc.scan(io.BytesIO(data[:-5]), 0, len(data) - 5))) == 2


def test_no_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    assert warc.read(spark, folder, warc.write(pages(spark).where("false"), folder)).collect() == []


def test_small_table(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op5_warc(spark, small).collect()), key=repr) == expected(rows)
