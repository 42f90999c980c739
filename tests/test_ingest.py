import json

import pytest
from pyspark.sql import functions as F

from lexmill.api import KnowledgeBase
from lexmill.config import Config
from lexmill.errors import ConfigurationError, Invalid, NotFound
from lexmill.operators import embedding, search
from lexmill.sources import files, tables


def pdf(content):
    if content == b"broken":
        raise RuntimeError("cannot read it")
    return content.decode().split("\f")


def summary(text, name):
    return {"title": f"Summary of {name}", "short_description": text[:20], "long_description": text[:60]}


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "kb"
    at.mkdir()
    (at / "a.md").write_text("# Alpha Document\n\n" + "The alpha document speaks about rivers and lakes. " * 5)
    (at / "b.pdf").write_bytes(b"Beta pages speak about mountains and rivers.\fThe second page speaks about glaciers.\f?")
    (at / "broken.pdf").write_bytes(b"broken")
    return at


def counted(kb):
    kb.rescan_documents()
    r, kb.report = kb.report, type(kb.report)()
    return r.parsed, r.chunked, r.embedded, r.summarised


def versions(spark, store):
    return {n: tables.current(spark, f"{store}/{n}") for n in ("parsed", "chunked", "vectors", "summaries")}


def test_stages_run_again_only_as_far_as_a_setting_reaches(spark, tmp_path, root):
    store = f"{tmp_path}/store"
    make = lambda **c: KnowledgeBase(spark, str(root), store, Config(max_parallel_parsing=2, max_parallel_embedding=1, **c), parser=files.chained(pdf), summariser=summary)
    kb = make()
    assert counted(kb) == (3, 2, 4, 0) and kb.collection.documents.count() == 2
    for _ in range(2):  # a file that cannot be parsed is known too
        assert kb.rescan_documents() == {"new": 0, "modified": 0, "deleted": 0} and counted(kb) == (0, 0, 0, 0)
    rows = {r.path.rsplit("/", 1)[1]: r for r in tables.read(spark, f"{store}/documents").collect()}
    assert rows["broken.pdf"].error == "cannot read it" and rows["b.pdf"].error is None
    assert rows["b.pdf"].metadata["placeholder_pages"] == "[3]" and rows["b.pdf"].metadata["document_type"] == "pdf"
    assert kb.search_documents("glaciers", 5, search_type="text").first().path.endswith("b.pdf")

    before = versions(spark, store)
    assert counted(make(embedder="other")) == (0, 0, 4, 0)  # vectors alone
    now = versions(spark, store)
    assert now["parsed"] == before["parsed"] and now["chunked"] == before["chunked"] and now["vectors"] != before["vectors"]

    parsed, chunked, embedded, _ = counted(make(embedder="other", chunk_size=60, chunk_overlap=0))  # chunks and vectors
    assert parsed == 0 and chunked == 2 and embedded > 4 and versions(spark, store)["parsed"] == before["parsed"]

    kb = make(embedder="other", chunk_size=60, chunk_overlap=0, summarise=True)
    assert counted(kb) == (0, 0, 0, 2)  # summaries from what was parsed
    assert {r.title for r in kb.collection.documents.collect()} == {"Summary of a.md", "Summary of b.pdf"}
    assert counted(make(embedder="other", chunk_size=60, chunk_overlap=0, summarise=True, pdf_parser="next"))[0] == 3  # all

    (root / "a.md").write_text("# Alpha Document\n\nNow deserts.")
    kb = make(embedder="other", chunk_size=60, chunk_overlap=0, summarise=True, pdf_parser="next")
    assert kb.rescan_documents() == {"new": 0, "modified": 1, "deleted": 0} and (kb.report.parsed, kb.report.chunked) == (1, 1)
    assert kb.search_documents("lakes", 5, search_type="text").count() == 0 and kb.search_documents("deserts", 5, search_type="text").count() == 1
    kinds = make(embedder="other", chunk_size=60, chunk_overlap=0, summarise=True, pdf_parser="next", text_analyzer="stemming")
    kinds.rescan_documents()
    assert kinds.search_documents("desert", 5, search_type="text").count() == 1


def test_files_given_one_by_one(spark, tmp_path, root):
    other = tmp_path / "elsewhere.md"
    other.write_text("# Elsewhere\n\nIt speaks about oceans.")
    kb = KnowledgeBase(spark, str(root), f"{tmp_path}/store", parser=files.chained(pdf))
    kb.rescan_documents()
    row = kb.add_document(str(other), {"owner": "ann", "year": 2024}).first()
    assert row.title == "Elsewhere" and row.metadata["owner"] == "ann" and row.metadata["year"] == "2024" and kb.report.parsed == 1
    assert kb.rescan_documents() == {"new": 0, "modified": 0, "deleted": 0}
    assert kb.search_documents("oceans", 5, {"owner": "ann"}).count() == 1 and kb.search_documents("oceans", 5, {"owner": "bob"}).count() == 0
    assert kb.add_document(str(other), {"owner": "bob"}).first().metadata["owner"] == "bob" and kb.report.parsed == 0
    with pytest.raises(NotFound):
        kb.add_document(f"{tmp_path}/none.md")
    with pytest.raises(Invalid):
        kb.add_document(str(root / "broken.pdf"))
    up = kb.upload_document("note.md", b"# Note\n\nuploaded text", {"kind": "upload"}).first()
    assert "/uploads/note_" in up.path and kb.search_documents("uploaded", 5, {"kind": "upload"}).count() == 1
    listed = json.loads(kb.resource("doc://list"))
    assert {r["title"] for r in listed} >= {"Elsewhere", "Note"} and {r["total"] for r in listed} == {len(listed)}
    whole, part = json.loads(kb.resource(f"doc://{up.document_id}")), json.loads(kb.resource("doc://a.md/chunk/0,9"))
    assert whole[0]["title"] == "Note" and [r["missing"] for r in part] == [False, True]
    for bad in ("doc://", "file://list"):
        with pytest.raises(Invalid):
            kb.resource(bad)
    m = kb.host_metrics().first()
    assert m.cpus > 0 and 0 <= m.memory_percent <= 100 and 0 <= m.disk_percent <= 100
    kb.remove_document(up.document_id)
    assert kb.search_documents("uploaded", 5, search_type="text").count() == 0
    other.unlink()
    assert kb.rescan_documents()["deleted"] == 1 and kb.search_documents("oceans", 5, search_type="text").count() == 0


def test_unchanged_files_are_not_read(spark, tmp_path, root):
    import os

    for k, p in enumerate(sorted(root.iterdir())):
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    kb = KnowledgeBase(spark, str(root), f"{tmp_path}/store", parser=files.chained(pdf))
    assert kb.rescan_documents() == {"new": 3, "modified": 0, "deleted": 0}
    a, before = root / "a.md", (root / "a.md").stat()
    other = a.read_bytes().replace(b"lakes", b"seas.")
    a.write_bytes(other)
    os.utime(a, (before.st_mtime, before.st_mtime))  # same size, same time: nobody looks inside
    assert kb.rescan_documents() == {"new": 0, "modified": 0, "deleted": 0}
    assert kb.rescan_documents(deep=True) == {"new": 0, "modified": 1, "deleted": 0}
    assert kb.search_documents("seas", 5, search_type="text").count() == 1
    os.utime(a, (before.st_mtime + 0.5, before.st_mtime + 0.5))  # touched: read, and found to be the same
    assert kb.rescan_documents() == {"new": 0, "modified": 0, "deleted": 0}
    plan = files.listed(files.scan(spark, str(root)))._jdf.queryExecution().toString()
    assert "content" not in plan[plan.index("Physical Plan") :]


def test_contents_of_many_files(spark, root, monkeypatch):
    every = files.scan(spark, str(root))
    some = every.select("path").where("path like '%.pdf'")
    for bound in (10_000, 1):
        monkeypatch.setattr(files, "BY_NAME", bound)
        assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.contents(spark, every, some).collect()} == {p.name: p.read_bytes() for p in root.glob("*.pdf")}
    assert files.contents(spark, every, some.where("false")).count() == 0


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/t"
    for n in range(5):
        tables.publish(spark.range(n + 1), root)
    kept = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert len([k for k in kept if k.startswith("v-")]) == tables.KEPT and tables.read(spark, root).count() == 5
    (tmp_path / "t" / "v-unfinished").mkdir()  # a writer that died before its pointer
    assert tables.read(spark, root).count() == 5


def test_scopes_are_shared(spark, tmp_path):
    a, b = (search.StoredScopes(spark, f"{tmp_path}/scopes", 10) for _ in range(2))
    assert a.get("s", 0.0) is None
    a.put("s", ["d1", "d2"], 100.0)
    b.put("t", ["d3"], 105.0)
    assert b.get("s", 109.0) == ["d1", "d2"] and a.get("t", 109.0) == ["d3"] and a.get("s", 111.0) is None
    a.put("s", ["d4"], 112.0)
    assert b.get("s", 113.0) == ["d4"] and a.get("t", 114.0) == ["d3"]


def test_embedders_that_take_one_text(spark):
    seen = []
    one = embedding.one_by_one(lambda t: seen.append(t) or [float(len(t))])
    assert one(["a", "bbb"]) == [[1.0], [3.0]] and seen == ["a", "bbb"]
    chunks = spark.createDataFrame([(1, "x"), (2, "yy")], "chunk_id int, text string")
    assert {r.chunk_id: r.embedding for r in embedding.embedded(chunks, embedding.one_by_one(lambda t: [float(len(t))])).collect()} == {1: [1.0], 2: [2.0]}
    old = spark.createDataFrame([(f"h{k}", [float(k)], float(k)) for k in range(20)], "text_hash string, embedding array<float>, used double")
    assert {r.text_hash for r in embedding.latest_used(old, 5).collect()} == {f"h{k}" for k in range(15, 20)}
    assert embedding.latest_used(old, 5).where(F.col("used") < 15).count() == 0


def test_parallel_settings():
    assert Config.from_environment(environment={"LEXMILL_MAX_PARALLEL_PARSING": "3"}).max_parallel_parsing == 3
    with pytest.raises(ConfigurationError):
        Config(max_parallel_embedding=0)
