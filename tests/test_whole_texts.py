"""Documents without pages: each text is one chunk, as it is."""

from collections import Counter

from lexmill.operators import chunking
from lexmill.plans import queries

ROWS = [(1, "plain"), (2, None), (3, ""), (4, " \n\t"), (5, "--[PAGE: 1]--\nfirst"), (6, "--[PAGE:2]--"), (7, "a\n--[PAGE: 3]--\nb"), (8, "same"), (8, "same"), (8, None), (8, ""), (None, "keyless")]


def test_query_keeps_every_row_and_text(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["c8_whole_text"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "text"] and Counter(map(tuple, got.collect())) == Counter(ROWS)


def test_least_size_of_the_trimmed_text(spark):
    documents = spark.createDataFrame([("a", "  12345\n"), ("b", "  1234\n"), ("c", None), ("d", "")], "document_id string, text string")
    assert [tuple(r) for r in chunking.whole_texts(documents, 5).collect()] == [("a", 0, 1, "  12345\n")]
    assert chunking.whole_texts(documents).count() == 4
