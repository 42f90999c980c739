import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import topk


def brute(qid, q, cid, c, k):
    out = {}
    for i, a in zip(qid, q):
        clip = lambda s: max(topk.LOW, min(topk.HIGH, s))
        scored = sorted((-clip(sum(int(x) * int(y) for x, y in zip(a, b))), int(j)) for j, b in zip(cid, c) if j != i)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 60), st.sampled_from([3, 300, 2**30, 2**40]), st.booleans())
def test_search_equals_brute_force(seed, d, n, peak, rotate):
    r = np.random.default_rng(seed)
    c = r.integers(-peak, peak + 1, (n, d)).astype(float)
    c[:: 3] = c[0]  # ties
    axes = np.linalg.qr(r.normal(size=(d, d)))[0] if rotate else None
    ids = np.arange(n) * 7
    q, qid = c[:: 2].copy(), ids[:: 2]
    rows, found, scores = topk.search(qid, q, ids, c, 5, axes)
    got = {i: [] for i in qid}
    for row, i, s in zip(rows, found, scores):
        got[qid[row]].append((int(i), int(s)))
    want = brute(qid, q, ids, c, 5)
    for i in qid:
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == want[i]


def test_pruning_keeps_results_over_many_chunks(monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 7)
    r = np.random.default_rng(1)
    c = np.floor(r.normal(size=(400, 16)) * 256 * r.uniform(0.01, 2, (400, 1)))
    rows, found, scores = topk.search(np.arange(20), c[:20], np.arange(400), c, 5, np.linalg.svd(c, full_matrices=False)[2].T)
    want = brute(range(20), c[:20], range(400), c, 5)
    got = {}
    for row, i, s in zip(rows, found, scores):
        got.setdefault(row, []).append((i, s))
    assert {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in got.items()} == want


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(5, 60))
def test_search_above_a_threshold(seed, d, n):
    r = np.random.default_rng(seed)
    c = r.integers(-4, 5, (n, d)).astype(float)
    want = brute(range(n), c, range(n), c, 3)
    least = np.array([want[i][-1][1] if len(want[i]) == 3 else -np.inf for i in range(n)], dtype=float)
    rows, found, scores = topk.search(np.arange(n), c, np.arange(n), c, 3, None, least=least)
    got = {i: [] for i in range(n)}
    for row, i, s in zip(rows, found, scores):
        got[row].append((int(i), int(s)))
    assert {i: sorted(x, key=lambda y: (-y[1], y[0])) for i, x in got.items()} == want


def test_short_vectors_are_never_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 10)
    monkeypatch.setattr(topk, "QUERIES", 3 * 8 * 4)
    r = np.random.default_rng(3)
    c = np.floor(r.uniform(500, 1500, (160, 4)) * np.repeat([1, 0.001], [20, 140])[:, None])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "vec_id long, v array<double>")
    sent, real = [], topk.searched
    monkeypatch.setattr(topk, "searched", lambda left, right, keys, k, axes: sent.append(right.count()) or real(left, right, keys, k, axes))
    got = sorted(tuple(x) for x in topk.top_k(v.where("vec_id < 20"), v, 5).collect())
    want = brute(range(20), c[:20], range(160), c, 5)
    assert got == sorted((i, n + 1, j, s) for i, x in want.items() for n, (j, s) in enumerate(x))
    assert sent[1] < 160  # of 160 vectors for each of seven blocks


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (51, [1.0, 0.5]), (52, [-0.001, 2.0]), (53, None), (54, [None, 1.0]), (55, [nan, 1.0]), (56, [inf, 1.0]), (None, [9.0, 9.0]), (57, [1.0, 2.0, 3.0]), (58, []), (51, [1.0, 0.5])]
    e = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("block", "stripe", "v", "score", "rank")})
    v = topk.integers(e)
    got = sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v, 5).collect())
    assert got == [(0, 1, 50, 81920), (0, 2, 51, 81920), (0, 3, 52, 65280), (50, 1, 0, 81920), (50, 2, 51, 81920), (50, 3, 52, 65280)]
    none = topk.integers(e.where("false"))
    assert topk.top_k(none, none, 5).collect() == []


def test_blocks_without_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 8)  # as many blocks as queries: by hash, some are empty
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in topk.top_k(v.where("vec_id < 9"), v, 2).collect())
    c = np.array([[i % 5, 1.0] for i in range(40)])
    want = brute(range(9), c[:9], range(40), c, 2)
    assert got == sorted((i, n + 1, j, s) for i, x in want.items() for n, (j, s) in enumerate(x))


@pytest.mark.parametrize("stripe", [3, 100_000])
def test_stripes_and_blocks(spark, small, monkeypatch, stripe):
    monkeypatch.setattr(topk, "STRIPE", stripe * 20 * 8 * 64)
    monkeypatch.setattr(topk, "LEAST", stripe * 20)
    monkeypatch.setattr(topk, "QUERIES", 4 * 8 * 64)
    got = sorted(tuple(r) for r in topk.op1_exact_top_k(spark, small).collect())
    t = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    c = np.floor(np.stack(t.embedding.to_numpy()).astype(float) * 256)
    q = t.vec_id.to_numpy() % 50 == 0
    want = brute(t.vec_id[q], c[q], t.vec_id, c, 5)
    assert got == sorted((i, n + 1, j, s) for i, x in want.items() for n, (j, s) in enumerate(x))


def test_what_the_driver_holds_of_many_stripes_and_blocks():
    import time

    r = np.random.default_rng(4)
    stripes = list(enumerate(sorted(r.uniform(0, 9, 30_000).tolist(), reverse=True)))
    blocks = list(enumerate(sorted([-np.inf, *r.uniform(-1, 10, 1199).tolist()])))
    start = time.perf_counter()
    for_stripe, for_block = topk.needed(stripes, blocks)
    assert time.perf_counter() - start < 1 and for_stripe.sum() == for_block.sum()
    enough = lambda long, least: long * (1 + 1e-9) + 1e-6 >= least
    for k in range(0, 30_000, 997):
        assert for_stripe[k] == sum(enough(stripes[k][1], least) for _, least in blocks)
    for k in range(0, 1200, 97):
        assert for_block[k] == sum(enough(long, blocks[k][1]) for _, long in stripes)
    assert [x.tolist() for x in topk.needed([], blocks[:2])] == [[], [0, 0]]
