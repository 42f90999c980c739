from pyspark.sql import functions as F

from lexmill.functions import ids
from lexmill.functions import metadata as M
from lexmill.functions import text as T
from lexmill.operators import embedding, textindex


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string").select(column.alias("r")).first().r


def test_identifiers(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert one(spark, ids.document_id(F.lit("/a.md"), F.lit("abc123"))) == "doc_" + sha("/a.md|abc123")
    assert one(spark, ids.chunk_id(F.lit("doc_1"), F.lit(2), F.lit("text"), F.lit(None).cast("int"))) == "chunk_" + sha("doc_1|2|text|None")
    assert one(spark, ids.chunk_id(F.lit("doc_1"), F.lit(2), F.lit("text"), F.lit(3))) != one(spark, ids.chunk_id(F.lit("doc_2"), F.lit(2), F.lit("text"), F.lit(3)))


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("x")), x="The Iechä v1.2 a_b is .5 end. I x") == ["iechä", "v1.2", "a_b", "end"]


def test_titles(spark):
    assert one(spark, T.heading_title(F.col("x")), x="intro\n# **My** `code` [link](http://a) *x* \n") == "My code link x"
    assert one(spark, T.heading_title(F.col("x")), x="no heading") is None
    assert one(spark, T.inferred_title(F.col("x"), F.lit("stem")), x="\nTITLE IN CAPS\nSentence here. It ends\nGood Title Line\n") == "Good Title Line"
    assert one(spark, T.inferred_title(F.col("x"), F.lit("stem")), x="## Heading line\n") == "Heading line"
    assert one(spark, T.inferred_title(F.col("x"), F.lit("stem")), x="short\nx") == "stem"


def test_paths(spark):
    assert one(spark, F.struct(T.file_name(F.col("x")), T.file_stem(F.col("x")), T.file_suffix(F.col("x"))), x="/a/b.c/d.e.MD") == ("d.e.MD", "d.e", ".md")
    assert one(spark, T.file_suffix(F.col("x")), x="/a/.hidden") == ""


def test_truncation(spark):
    assert one(spark, T.truncated(F.col("x"), 2), x="12345678") == "12345678"
    assert one(spark, T.truncated(F.col("x"), 2), x="1234567.9012") == "1234567." + T.NOTICE
    assert one(spark, T.truncated(F.col("x"), 2), x="12.456789012") == "12.45678" + T.NOTICE


def test_retry_after(spark):
    for text, want in (("Please retry after 12 s", 12), ("try again in 7s", 7), ("Wait 3 seconds", 3), ("Rate limit reached, 9 seconds", 9), ("Retry-After: 30", 30), ("no", None)):
        assert one(spark, T.retry_after(F.col("x")), x=text) == want


def test_highlight(spark):
    assert one(spark, T.highlighted(F.col("x"), ["a.b", "Dog"]), x="dog axb a.b DOG") == "<mark>dog</mark> axb <mark>a.b</mark> <mark>DOG</mark>"


def test_summaries(spark):
    good = 'so: {"title": " T ", "short_description": "s", "long_description": "l"} end'
    assert one(spark, embedding.parsed_summary(F.col("x")), x=good).title == "T"
    assert one(spark, embedding.parsed_summary(F.col("x")), x='{"title": "T", "short_description": " ", "long_description": "l"}') is None
    assert one(spark, embedding.parsed_summary(F.col("x")), x="nothing") is None


def test_metadata(spark):
    m = F.create_map(F.lit("a"), F.lit("10"), F.lit("b"), F.lit("x"))
    n = F.create_map(F.lit("b"), F.lit("y"))
    holds = lambda where: one(spark, M.predicate(where, [], m, n))
    assert one(spark, M.merged(m, n)) == {"a": "10", "b": "y"}
    assert holds({"a": {"$gt": 9}}) and not holds({"a": {"$gt": "9"}}) and holds({"doc_b": "x"}) and holds({"b": ["q", "x"]})
    assert not holds({"c": {"$ne": 1}}) and not holds({"c": {"$nin": [1]}}) and holds({"$or": [{"c": 1}, {"b": {"$nin": ["z"]}}]})
    flat = M.flattened(F.create_map(F.lit("id"), F.lit("1")), m, n)
    assert one(spark, flat) == {"id": "1", "doc_a": "10", "doc_b": "x", "chunk_b": "y"}
    assert one(spark, M.unflattened(flat, "doc_")) == {"a": "10", "b": "x"}
    assert one(spark, M.loaded_page(F.lit("-1"))) is None and one(spark, M.loaded_page(F.lit("no"))) is None and one(spark, M.stored_page(F.lit(None))) == -1


CHUNKS = [
    ("chunk_001", "d1", "This is the first chunk about machine learning and AI."),
    ("chunk_002", "d1", "The second chunk discusses neural networks and deep learning."),
    ("chunk_003", "d2", "Python is a great language for data science."),
    ("chunk_004", "d3", "running runners run"),
]


def found(spark, query, analyzer="standard", **more):
    index = textindex.TextIndex.build(spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, text string"), analyzer)
    return [r.chunk_id for r in textindex.search(index, query, **more).collect()]


def test_text_search(spark):
    assert sorted(found(spark, "learning")) == ["chunk_001", "chunk_002"]
    assert found(spark, "machine learning") == ["chunk_001"]
    assert sorted(found(spark, "machine OR python")) == ["chunk_001", "chunk_003"]
    assert found(spark, "learning NOT machine") == found(spark, "learning -machine") == ["chunk_002"]
    assert found(spark, '"deep learning"') == ["chunk_002"] and found(spark, '"learning deep"') == []
    assert found(spark, "lang*") == ["chunk_003"] and found(spark, "(neural OR python) great") == ["chunk_003"]
    assert found(spark, "zzz") == [] and found(spark, "the") == [] and found(spark, "NOT learning") == [] and found(spark, "") == []
    assert found(spark, "learning", limit=1) and found(spark, "learning", min_score=99.0) == []
    assert found(spark, "learning", where=F.col("document_id") == "d2") == []


def test_stemming(spark):
    assert found(spark, "run", "stemming") == ["chunk_004"] and found(spark, "networking", "stemming") == ["chunk_002"]


def test_written_index(spark, tmp_path):
    index = textindex.TextIndex.build(spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, text string"))
    index.write(f"{tmp_path}/i", 8)
    again = textindex.TextIndex.read(spark, f"{tmp_path}/i")
    rows = lambda i: [tuple(r) for r in textindex.search(i, "chunk learning").collect()]
    assert rows(again) == rows(index) and rows(index)
    plan = textindex.search(again, "python")._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and plan.split("== Physical Plan ==")[1].count("FileScan") == 1
    assert textindex._bucket("python", 8) == spark.range(1).select(F.pmod(F.xxhash64(F.lit("python")), F.lit(8))).first()[0]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(5).select("id", F.col("id").cast("string").alias("s")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(M.predicate({"id": {"$gt": 2}, "s": ["3", "4"]}, dict(df.dtypes)))._jdf.queryExecution().toString()
    assert "GreaterThan(id,2)" in plan and "In(s, [3,4])" in plan
