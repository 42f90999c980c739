import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import components, simhash

from . import edge


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[k : k + 3] for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_classes(rows, bits=2):
    """(doc_id, fp) -> smallest doc_id reachable, nulls last."""
    fps = sorted({f for _, f in rows})
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i:] if bin(a ^ b).count("1") <= bits]
    root = brute_components(links, fps)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[root[f]] = min(doc, least.get(root[f], doc))
    return {f: least.get(root[f]) for f in fps}


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \n", "One", "one TWO", "a b c d", "É b c d\x1fe f", "x" * 100_000, "a b " * 5000]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    text = " ".join(str(i * i) for i in range(100))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_fingerprint_agrees_with_the_engine_hash(spark):
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert simhash.fingerprint(b"One two THREE") == row.h & (2**64 - 1)


@pytest.mark.parametrize("most", [2, 16, 1000])
def test_classes_equal_brute_force(spark, most):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(15)]
    fps = set()
    for c in centres:  # crowded balls and chains
        f = c
        for _ in range(25):
            f ^= 1 << r.randrange(64)
            fps |= {f, c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))}
    fps |= {0, 1, 3, 7, 15, 2**63, 2**64 - 1}
    rows = [(i, f) for i, f in enumerate(r.sample(sorted(fps), len(fps)))] + [(5000 + k, 0) for k in range(40)] + [(None, 2**63 + 2**5)]
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in rows], "doc_id long, fp long")
    got = {int(np.int64(x.fp).view(np.uint64)): x.component_id for x in simhash.classes(df, most=most).collect()}
    assert got == brute_classes(rows)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(7000, 7000), (9, None)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + k: 1000 for k in range(200)}}
    assert components.components(df.where("false")).collect() == []


def test_small_table(spark, small):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_classes(docs)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, small).collect()}
    assert got == {(i, f"{f:016x}", want[f]) for i, f in docs}


def test_odd_documents(spark):
    docs = edge.documents(spark)
    got = edge.rows(simhash.near_duplicates(docs))
    rows = [(i, brute_fingerprint(t)) for i, t in edge.TEXTS]
    want = brute_classes(rows)
    assert got == sorted(((i, f"{f:016x}", want[f]) for i, f in rows), key=repr)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    by = defaultdict(list)
    for r in kept.select("doc_id", "text").collect():
        by[want[brute_fingerprint(r.text)]].append(r.doc_id)
    assert {k: len(v) for k, v in by.items()} == {c: 1 for c in set(want.values())}
    assert all(v == [k] for k, v in by.items())
    assert simhash.near_duplicates(edge.empty(spark)).collect() == []
    assert simhash.deduplicated(edge.empty(spark)).collect() == []


def test_documents_without_ids(spark):
    docs = spark.createDataFrame([(None, "some text that is here"), (None, "some text that is here"), (None, "quite another one with more words")], "doc_id long, text string")
    kept = simhash.deduplicated(docs.withColumn("x", F.lit(1))).collect()
    assert sorted(r.text for r in kept) == ["quite another one with more words", "some text that is here"]
