import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import batches, chunking, embedding, textindex
from lexmill.plans import queries

NAMES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def unset(spark):
    before = {n: spark.conf.get(n, None) for n in NAMES}
    for n in NAMES:
        spark.conf.unset(n)
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def largest(spark):
    """Rows of the largest batch that a worker gets of 20,000."""
    rows = spark.range(20_000).coalesce(1).mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in parts), "n long")
    return rows.agg(F.max("n")).first()[0]


@pytest.mark.parametrize("operator", ["embedding", "chunks", "stems"])
def test_workers_get_bounded_batches(unset, small, operator):
    docs = unset.createDataFrame([(1, "One two. Three four.")], "doc_id long, text string")
    assert largest(unset) > batches.ROWS
    if operator == "embedding":
        embedding.with_hashed(docs)
    elif operator == "chunks":
        chunking.chunked(docs, chunking.chunker("recursive"), "doc_id")
    else:
        queries.QUERIES["q3_stemming_analyzer"](unset, small)
    assert largest(unset) <= batches.ROWS


def test_embedding_without_its_text(spark):
    docs = spark.createDataFrame([(1, "river lake river"), (2, None)], "doc_id long, text string")
    whole, mine = embedding.with_hashed(docs), embedding.with_hashed(docs, text=False)
    assert mine.columns == ["doc_id", "embedding"] and mine.collect() == whole.drop("text").collect()


def test_batch_search_makes_tokens_once(spark):
    """What is planned for the ranking reads the hits from files: no text is analysed again."""
    c = spark.createDataFrame([("c1", "d1", "river lake"), ("c2", "d2", "river stone")], "chunk_id string, document_id string, text string")
    asked = spark.createDataFrame([(1, "river lake")], "query_id long, text string")
    out = textindex.search_batch(textindex.TextIndex.build(c), asked, 5)
    assert [(r.query_id, r["rank"], r.chunk_id) for r in out.collect()] == [(1, 1, "c1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 0
