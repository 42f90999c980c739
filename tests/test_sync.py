import datetime
import time

import pytest
from pyspark.sql import functions as F

from lexmill.api import KnowledgeBase
from lexmill.config import Config
from lexmill.errors import ConfigurationError, Forbidden, Invalid, NotFound
from lexmill.operators import cache, jobs, sync
from lexmill.sources import files, tables
from lexmill.streaming import events as E


def test_knowledge_base(spark, tmp_path):
    root, store = tmp_path / "kb", f"{tmp_path}/store"
    (root / "uploads").mkdir(parents=True)
    (root / "a.md").write_text("---\nowner: ann\n---\n# Alpha Document\n\nThe alpha document speaks about rivers and lakes.\n")
    (root / "b.md").write_text("# Beta Document\n\nThe beta document speaks about mountains and rivers.\n")
    (root / "uploads" / "c.md").write_text("# Excluded\n\nrivers\n")
    (root / "d.txt").write_text("rivers")
    kb = KnowledgeBase(spark, str(root), store)
    assert kb.rescan_documents() == {"new": 2, "modified": 0, "deleted": 0}
    assert kb.rescan_documents() == {"new": 0, "modified": 0, "deleted": 0}
    rows = kb.search_documents("rivers", 5).collect()
    assert {r.title for r in rows} == {"Alpha Document", "Beta Document"} and {r.page_number for r in rows} == {1}
    assert kb.search_documents("rivers", 5, {"owner": "ann"}).count() == 1
    before = {r.path: r.document_id for r in kb.collection.documents.collect()}
    (root / "a.md").write_text("# Alpha Document\n\nNow it speaks about deserts only.\n")
    (root / "b.md").unlink()
    (root / "e.md").write_text("# Epsilon\n\nNew file about oceans.\n")
    assert kb.rescan_documents() == {"new": 1, "modified": 1, "deleted": 1}
    after = {r.path: r.document_id for r in kb.collection.documents.collect()}
    assert set(after) == {str(root / "a.md"), str(root / "e.md")} and after[str(root / "a.md")] != before[str(root / "a.md")]
    assert kb.search_documents("rivers", 5, search_type="text").count() == 0 and kb.search_documents("deserts", 5, search_type="text").count() == 1
    assert kb.get_document("a.md").first().chunks[0].text.endswith("deserts only.") and kb.get_chunks("a.md", "0,7").count() == 2
    with pytest.raises(NotFound):
        kb.get_document("none.md")
    with pytest.raises(Invalid):
        kb.search_documents(" ")
    with pytest.raises(Forbidden):
        kb.remove_document(after[str(root / "a.md")])
    (root / "e.md").unlink()
    kb.remove_document(after[str(root / "e.md")])
    assert kb.statistics().first().documents == 1 and kb.list_documents()[1]["total"] == 1
    again = KnowledgeBase(spark, str(root), store, Config(chunk_size=20, chunk_overlap=5))
    again.rescan_documents()
    assert again.collection.chunks.count() > kb.collection.chunks.count()


def test_delta(spark):
    scan = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 2, 1.0, "x"), ("c", 1, 2.5, "x"), ("d", 1, 1.9, "x"), ("e", 1, 1.0, "y")], "path string, file_size long, last_modified double, checksum string")
    index = spark.createDataFrame([(p, 1, 1.0, "x") for p in "bcdez"], "path string, file_size long, last_modified double, checksum string")
    assert {r.path: r.change for r in sync.changes(scan, index).collect()} == {"a": "new", "b": "modified", "c": "modified", "e": "modified", "z": "deleted"}
    docs = spark.createDataFrame([("/r/a", "1"), ("/r/uploads/b", "2"), ("/o/c", "3"), ("/r/d", "4")], "path string, document_id string")
    may = {r.path: r.may_delete for r in sync.deletable(docs, "/r", docs.where("path <> '/r/d'")).collect()}
    assert may == {"/r/a": False, "/r/uploads/b": True, "/o/c": True, "/r/d": True}


def test_tables(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert tables.read(spark, root) is None
    tables.publish(spark.range(3), root)
    first = tables.read(spark, root)
    tables.publish(first.where("id > 0"), root)
    assert first.count() == 3 and tables.read(spark, root).count() == 2
    tables.drop(spark, root)
    assert tables.read(spark, root) is None


def test_fingerprints():
    now = Config().stage_settings()
    stored = {k: cache.fingerprint(v) for k, v in now.items()}
    assert cache.changed_stages(now, stored) == set() and cache.changed_stages(now, {}) == set(now)
    other = Config(page_min_chunk_size=50).stage_settings()
    assert cache.invalidated(cache.changed_stages(other, stored)) == {"chunking", "embedding"}
    assert cache.load_fingerprints("{broken") == {} and cache.load_fingerprints(None) == {} and cache.load_fingerprints('{"a": "b", "c": 1}') == {"a": "b"}
    assert cache.fingerprint({"a": 1, "b": 2}) == cache.fingerprint({"b": 2, "a": 1})


def test_config():
    for bad in ({"chunk_overlap": 1000}, {"vector_weight": 0.9}, {"rrf_k": 0}, {"text_analyzer": "x"}, {"text_min_score": 2}):
        with pytest.raises(ConfigurationError):
            Config(**bad)
    c = Config.from_environment(environment={"LEXMILL_CHUNK_SIZE": "500", "LEXMILL_RERANK": "yes", "LEXMILL_SUPPORTED_EXTENSIONS": ".md, .txt", "LEXMILL_RRF_K": "10"})
    assert (c.chunk_size, c.rerank, c.supported_extensions, c.rrf_k) == (500, True, (".md", ".txt"), 10)


def test_pdf(spark):
    rows = spark.createDataFrame([("/a.pdf", bytearray(b"one\ftwo words here")), ("/b.pdf", bytearray(b"bad"))], "path string, content binary")
    assert [r.error is not None for r in files.pdf_pages(rows).collect()] == [True, True]

    def parser(content):
        if content == b"bad":
            raise RuntimeError("cannot")
        return content.decode().split("\f")

    got = files.pdf_pages(rows, files.chained(parser)).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.content, r.error) for r in got] == [(1, "[Page 1: no text]", None), (2, "two words here", None), (None, None, "cannot")]
    assert files.upload_name("a.b.pdf", 12, "0123456789") == "a.b_12_01234567.pdf"


def test_jobs(spark):
    q = spark.createDataFrame([(1, 1, "LOW", "queued", 0), (2, 2, "HIGH", "queued", 2), (3, 3, "NORMAL", "queued", 0), (4, 4, "HIGH", "queued", 0), (5, 5, "HIGH", "running", 0)], "job_id int, sequence int, priority string, status string, attempts int")
    assert [r.job_id for r in jobs.next_jobs(q, 3).collect()] == [2, 4, 3]
    done = {r.job_id: (r.status, r.attempts) for r in jobs.after_run(q, spark.createDataFrame([(2, False), (4, True), (3, False)], "job_id int, success boolean")).collect()}
    assert done == {1: ("queued", 0), 2: ("failed", 3), 3: ("queued", 1), 4: ("completed", 1), 5: ("running", 0)}
    assert {r.job_id for r in jobs.cancelled(q, q.select("job_id")).where("status = 'cancelled'").collect()} == {1, 2, 3, 4}


def stamp(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_batch_events(spark):
    e = spark.createDataFrame([("a", stamp(0), "created"), ("a", stamp(5), "modified"), ("a", stamp(60), "deleted"), ("b", stamp(1), "created")], "path string, ts timestamp, event_type string")
    got = sorted((r.path, r.events, r.event_type) for r in E.debounced(e, "path", 10).collect())
    assert got == [("a", 1, "deleted"), ("a", 2, "modified"), ("b", 1, "created")]
    assert E.rate_windows(e, "path", limit=1).where("limited").count() == 1
    assert E.subscribed(e, None).count() == 4 and E.subscribed(e, {"path": "a", "event_type": ["created", "deleted"]}).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    e = spark.createDataFrame([("a", stamp(0), "created"), ("a", stamp(5), "modified"), ("b", stamp(1), "created"), ("b", stamp(300), "x")], "path string, ts timestamp, event_type string")
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = E.rate_windows(stream(), "path", limit=1).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, E.rate_windows(e, "path", limit=1).collect()))
    q = E.debounced_stream(stream(), "path", 1.0).writeStream.format("memory").queryName("bounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    end = time.time() + 40
    while time.time() < end and spark.table("bounced").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, spark.table("bounced").collect())) == [("a", "modified", 2), ("b", "x", 2)]


def test_new_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    q = E.new_file_stream(spark, f"{tmp_path}/in").select(F.decode("content", "UTF-8").alias("t")).writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.md").write_text("y")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.t for r in spark.table("files").collect()) == ["x", "y"]
