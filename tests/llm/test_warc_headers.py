import io
import random
import time

import pytest
from pyspark.sql import functions as F

from lexmill.llm import warc


@pytest.mark.parametrize("split", [1000, 4 << 20])
def test_long_urls(spark, tmp_path, split):
    r = random.Random(8)
    urls = ["data:" + "".join(map(chr, r.choices(range(33, 127), k=n))) for n in (10, 100_000, 10, 1_000_000, 70_000)]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder)
    got = warc.counted(warc.read(spark, folder, manifest, split).select("page_id", "url"), manifest)
    assert {x.page_id: x.url for x in got.collect()} == dict(enumerate(urls))


def test_missing_records_are_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder)
    with pytest.raises(RuntimeError, match="read 1 records of 2"):
        warc.counted(warc.read(spark, folder, manifest).where(F.col("page_id") == 1), manifest)


def test_large_record_is_read_in_linear_time():
    r = random.Random(9)
    times = []
    for size in (2 << 20, 24 << 20):
        body = r.randbytes(size // 2).hex().encode()
        data = warc.record(1, "u", b"small", 5, "d", None) + warc.record(2, "u", body, size, "d", None) + warc.record(3, "u", b"last", 4, "d", None)
        start = time.process_time()
        got = list(warc.scan(io.BytesIO(data), 0, len(data)))
        times.append(time.process_time() - start)
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [b"small", body, b"last"]
    assert times[1] < 4 * 12 * max(times[0], 0.01)


def test_false_start_in_a_large_member_is_read_over():
    body = random.Random(3).randbytes(3 << 20)
    cut = warc.record(1, "u", body, len(body), "d", None)[: 2 << 20]  # a member that breaks off
    data = cut + warc.record(2, "u", b"whole", 5, "d", None)
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.scan(io.BytesIO(data), 0, len(data))] == [b"whole"]
