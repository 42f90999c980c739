import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import simhash, similar

from .test_simhash import brute_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows, share=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x == y or len(x & y) >= share * len(x | y)]
    root = brute_components(links, [i for i, _ in rows])
    return {i for i, r in root.items() if i == r}


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("slots", [4, 24])  # few classes make the order coarse and change nothing else
def test_stage_equals_brute_force(spark, slots, monkeypatch):
    r, vocabulary = random.Random(4), [f"w{k}" for k in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common, rows = make(40), []
    for _ in range(15):  # near copies at all distances
        words = make(r.randrange(20, 200))
        rows += [edited(r, words, k) for k in range(0, 8)]
    crowd = make(200)
    rows += [edited(r, crowd, r.randrange(0, 7)) for _ in range(40)]
    rows += [" ".join(common + make(n)) for n in [2, 3, 5, 9, 40, 60] * 5]  # a passage in common
    rows += ["", "a", "A", "one two three", "One two  three", "a b c d e f g h"]
    rows = list(enumerate(rows))
    real = similar.linked
    monkeypatch.setattr(similar, "linked", lambda docs, share: real(docs, share, slots))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id for x in simhash.deduplicated(docs).select("doc_id").collect()}
    want = brute_kept(rows)
    assert got == want and len(want) < len(rows) - 60


def test_levels_are_counts():
    r = np.random.default_rng(5)
    hashes = [r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1) for n in (0, 7, 900, 5000)]
    often = [np.concatenate([hashes[3][:k] for k in (4000, 900, 900, 100, 1)]), hashes[2], hashes[1], hashes[1][:3]]
    want: dict = {}
    every, times = np.unique(np.concatenate(often), return_counts=True)
    for h, n in zip(every.tolist(), times.tolist()):
        if n > 1:
            slot = h >> (64 - similar.SLOTS)
            want[slot] = max(want.get(slot, 0), n.bit_length())
    for bits in (1, 5, 12):
        ranges, parts = similar.Ranges(bits), {}
        for held in often:
            for part, once, more in ranges.cut(held) if len(held) else []:
                parts.setdefault(part, ([], []))
                parts[part][0].append(once)
                parts[part][1].append(more)
        table = np.zeros(1 << similar.SLOTS, dtype=np.uint8)
        width = 1 << (similar.SLOTS - bits)
        for part, (once, more) in parts.items():
            table[part * width : (part + 1) * width] = np.frombuffer(ranges.levels(once, more), dtype=np.uint8)
        assert {int(k): int(table[k]) for k in np.nonzero(table)[0]} == want


def test_near_copies_far_apart_in_bits(spark, small):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    kept = simhash.deduplicated(spark.read.parquet(f"{small}/documents.parquet"))
    got = {x.doc_id for x in kept.select("doc_id").collect()}
    assert got == brute_kept(rows)
    assert kept.where(F.col("doc_id").isin(145, 177)).count() == 0  # like 6 and 1, more than 2 bits apart


def test_pages_of_one_template(spark):
    """170 words in common and 30 of their own are 0.74 alike: no pair. Some have fewer of their own and are."""
    r = random.Random(12)
    common = [f"t{k}" for k in range(170)]
    rows = [(i, " ".join(common + [f"o{i}x{j}" for j in range(30 if i % 10 else r.randrange(14, 21))])) for i in range(300)]
    rows += [(300 + i, " ".join(common[: r.randrange(90, 110)] + [f"p{i}x{j}" for j in range(r.randrange(5, 30))])) for i in range(60)]
    got = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id").collect()}
    want = brute_kept(rows)
    assert got == want and 250 < len(want) < 340
