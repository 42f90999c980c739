import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.operators import blocks


def test_no_posting_is_shuffled_or_has_ids(spark):
    """One row of ids for many chunks, none for a posting, and no exchange between the chunks and their blocks."""
    rows = [(f"c{i:04d}", f"d{i}", [f"w{i % 7}", "river", "river"] if i % 5 else None) for i in range(300)]
    out = blocks.built(spark.createDataFrame(rows, "chunk_id string, document_id string, terms array<string>").coalesce(1))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.cache()
    assert got.where("term is not null and chunk_id is not null").count() == 0
    assert got.where("term is null").count() == -(-300 // blocks.NAMED)
    named = blocks.named(got.withColumn("segment", F.lit("s")))
    p = blocks.opened(got).join(named, ["shard", "number"])
    found = {(r.chunk_id, r.document_id, r.term, r.tf, r.length) for r in p.collect()}
    want = {(c, d, t, terms.count(t), len(terms)) for c, d, terms in rows if terms for t in set(terms)}
    assert found == want


def test_rows_of_a_shard():
    terms = pa.array([["b"], ["a", "b", "a"], ["a", "b", "c", "b"]])
    ids = pa.array(["x", "y", "z"])
    names, table = list(blocks.shard_rows(5, ids, ids, terms, 2, 1))
    assert names.column("chunk_id").to_pylist() == [["x", "y", "z"]]
    rows = {(r["term"], r["block"]): r for r in table.to_pylist()}
    assert sorted(rows) == [("a", 0), ("b", 0), ("b", 1), ("c", 0)]
    assert (rows["a", 0]["number"], rows["a", 0]["tf"], rows["a", 0]["positions"]) == ([1, 2], [2, 1], [[0, 2], [0]])
    assert (rows["b", 0]["number"], rows["b", 1]["number"], rows["b", 1]["positions"]) == ([0, 1], [2], [[1, 3]])
    assert rows["a", 0]["shortest"] == [4, 3, None, None] and rows["b", 1]["top_tf"] == 2 and np.all(np.array(rows["b", 0]["length"]) == [1, 3])
