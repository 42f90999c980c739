import bisect
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import fim

from . import edge


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2000), max_size=400), st.integers(1, 5000))
def test_select_equals_the_list(gaps, rest):
    values = (np.cumsum(gaps) - 1).astype(np.int64) if gaps else np.zeros(0, dtype=np.int64)
    size = int(values[-1]) + rest if gaps else 0
    b = fim.Boundaries.of(values, size)
    again = fim.Boundaries(b.n, size, b.width, b.low.tobytes(), b.high.tobytes())
    assert [again.select(k) for k in range(len(values) + 1)] == [*values.tolist(), size]
    assert len(b.high) <= (2 * len(values) + len(values) * 2 + 24) // 8 + 1  # some two bits of unary a value


@pytest.mark.parametrize("step", [8, 64])
def test_lists_laid_down_in_steps(step, monkeypatch):
    values = np.unique(np.random.default_rng(1).integers(0, 90_000, 5000))
    whole = fim.Boundaries.of(values, 90_000)
    monkeypatch.setattr(fim, "STEP", step)
    parts = fim.Boundaries.of(values, 90_000)
    assert parts.high.tobytes() == whole.high.tobytes() and parts.low.tobytes() == whole.low.tobytes()


def brute(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)


@pytest.mark.parametrize("weak, lot, broadcast", [(False, 4096, 2_000_000), (True, 4096, 2_000_000), (False, 5, 0)])
def test_equals_brute_force(spark, weak, lot, broadcast, monkeypatch):
    if weak:  # hashes that different texts share
        monkeypatch.setattr(fim, "key", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    monkeypatch.setattr(fim, "LOT", lot)
    monkeypatch.setattr(fim, "BROADCAST_IDS", broadcast)
    r = random.Random(8)
    shared = ["".join(r.choice("aé日🙂 \n<PSM>") for _ in range(r.randrange(0, 90))) for _ in range(12)]
    texts = [r.choice(shared) for _ in range(150)] + ["".join(r.choice("abc日") for _ in range(k)) for k in range(60)] + ["a <P> mark", "<S>", "x<M>", "hot"] + ["hot text"] * 90
    rows = list(enumerate(texts))
    out = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).cache()
    assert got(out) == sorted((brute(*x) for x in rows), key=repr)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    back = out.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert back.where(~fim.restored(F.col("output"), F.col("form")).eqNullSafe(F.col("text"))).count() == 0


def test_units_of_a_pattern(spark):
    rows = [(i, f"  one {i} two\nthree  ") for i in range(40)] + [(99, "?!"), (100, "")]
    out = fim.transformed(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, spm=50, unit=r"\w+").cache()
    text = dict(rows)
    for r in out.collect():
        n = len(text[r.doc_id].split()) if r.doc_id < 99 else int(r.doc_id == 99)
        assert r.n == n
        if r.form != "plain":
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            ends = [0, *(k for k in range(1, len(text[r.doc_id])) if text[r.doc_id][k - 1].isalnum() and not text[r.doc_id][k].isalnum()), len(text[r.doc_id])]
            assert all(ends[bisect.bisect_left(ends, x)] == x for x in (a, b))
    assert out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").where("back <> text").count() == 0


def test_odd_documents(spark):
    docs = edge.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(fim.transformed(docs)) == sorted((brute(*x) for x in rows), key=repr)
    assert got(fim.transformed(edge.empty(spark))) == []
