import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import cells, vectorsearch
from lexmill.operators.cells import VectorCells


def frame(spark, ids, vectors):
    return spark.createDataFrame([(f"c{i:04d}", None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], "chunk_id string, embedding array<float>")


def asked(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, embedding array<float>")


def rows(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


def clustered(r, n, d=8):
    centres = r.normal(size=(20, d)) * 4
    return centres[r.integers(0, 20, n)] + r.normal(size=(n, d)) * 0.3


def test_exact_rows_from_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 40)  # cells of several parts
    monkeypatch.setattr(cells, "QUERIES", 7)  # and queries of several blocks
    r = np.random.default_rng(1)
    v = clustered(r, 900)
    v[300:420] = v[0]  # one vector many times
    vectors = frame(spark, range(900), v)
    stored = VectorCells.build(vectors, f"{tmp_path}/v")
    q = asked(spark, np.concatenate([v[::60], r.normal(size=(3, 8)) * 9, [v[0]]]))
    want = rows(vectorsearch.search_batch(vectors, q, 6))
    assert rows(stored.search(q, 6)) == want
    share = stored.read_share(q, 6).collect()
    assert len(share) == 19 and sum(x.share for x in share) / len(share) < 0.5
    assert sum(x.n for x in stored.sizes().collect()) == 900


def test_probing_finds_nine_of_ten(spark, tmp_path):
    r = np.random.default_rng(2)
    v = clustered(r, 1500)
    vectors = frame(spark, range(1500), v)
    stored = VectorCells.build(vectors, f"{tmp_path}/v")
    q = asked(spark, clustered(np.random.default_rng(2), 1500)[::30])
    want = {(x[0], x[2]) for x in rows(vectorsearch.search_batch(vectors, q, 5))}
    got = {(x[0], x[2]) for x in rows(stored.search(q, 5, probes=6))}
    assert len(want & got) / len(want) >= 0.9
    assert all(x.cells <= 6 for x in stored.read_share(q, 5, probes=6).collect())


def test_inserts_write_what_is_new(spark, tmp_path):
    r = np.random.default_rng(3)
    v = clustered(r, 200, 4)
    all_rows = frame(spark, range(200), v)
    a = VectorCells.build(all_rows.where("chunk_id < 'c0150'"), f"{tmp_path}/v")
    b = VectorCells(spark, f"{tmp_path}/v")
    a = a.inserted(all_rows.where("chunk_id >= 'c0140' and chunk_id < 'c0180'"))
    b.inserted(all_rows.where("chunk_id >= 'c0160'"))  # from a list that is no longer the present one
    stored = VectorCells(spark, f"{tmp_path}/v")
    assert [spark.read.parquet(f"{tmp_path}/v/vectors/part={p}").count() for p in stored.parts] == [150, 30, 20]
    q = asked(spark, v[::9])
    assert rows(stored.search(q, 3)) == rows(vectorsearch.search_batch(all_rows, q, 3))


def test_odd_vectors(spark, tmp_path):
    data = [(0, [1, 0]), (1, [1, 0]), (2, None), (3, [0, 1, 2]), (4, []), (5, [5, 5]), (0, [1, 0])]
    vectors = frame(spark, [i for i, _ in data], [v for _, v in data]).unionByName(spark.createDataFrame([(None, [1.0, 0.0])], "chunk_id string, embedding array<float>"))
    stored = VectorCells.build(vectors, f"{tmp_path}/v")
    stored = stored.inserted(frame(spark, [7, 8], [[1, 2, 3, 4], [1, 1]]))  # a length that no cell has
    q = asked(spark, [[1, 0], [0, 1, 2], [1, 2, 3, 4], [9]])
    clean = frame(spark, [0, 1, 3, 5, 7, 8], [[1, 0], [1, 0], [0, 1, 2], [5, 5], [1, 2, 3, 4], [1, 1]])
    for limit in (1, 3, 10):
        assert rows(stored.search(q, limit)) == rows(vectorsearch.search_batch(clean, q, limit))
    assert stored.search(q.where(F.lit(False)), 3).count() == 0
