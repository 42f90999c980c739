import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.llm import ranked

from . import edge

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDED = str.maketrans(ranked.UPPER, ranked.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(FOLDED))


def brute(docs, items, k=50):
    """Every item against every document, from the description alone."""
    held = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("bound", [500_000, 0])  # 0: all joins by shuffle, under salts
def test_equals_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(ranked, "BROADCAST", bound)
    r = random.Random(3)
    word = lambda: r.choice(["the", "The", "ÉTÉ", "été", "x1", "日本", " "] + [f"w{r.randrange(60)}"] * 9)
    docs = [(i, r.choice([" ", ", ", "\n", "_"]).join(word() for _ in range(r.randrange(0, 60)))) for i in range(150)]
    docs += [(150 + i, docs[3][1]) for i in range(30)]  # ties
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 12)))) for i in range(25)]
    frames = [spark.createDataFrame(rows, f"{name} long, text string").repartition(3) for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    for k in (1, 7, 50):
        assert got(ranked.ranked(*frames, k)) == brute(docs, items, k)


def test_postings_of_all_terms_serve_any_items(spark):
    docs = [(i, f"a{i % 7} b{i % 3} c the the") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    postings = ranked.Postings.build(frame)
    assert postings.n_documents == 60 and postings.all_terms == 300
    assert postings.table.count() == 240 and postings.table.where("bucket <> pmod(xxhash64(term), 256)").count() == 0
    for items in ([(1, "a1 b2"), (2, "nothing")], [(3, "the c")]):
        asked = ranked.item_terms(spark.createDataFrame(items, "item_id long, text string"))
        assert got(postings.search(asked, 9)) == brute(docs, items, 9)


def test_odd_rows(spark):
    docs = edge.documents(spark)
    items = [(1, "text of ten words"), (1, "repeated row"), (2, None), (3, ""), (None, "text"), (4, "日本語 ünïcödé"), (5, "x" * 200_000)]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in edge.CLASHES})
    out = ranked.ranked(docs, frame)
    assert [c for c in out.columns] == ["item_id", "rank", "doc_id", "score"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(out) == brute(rows, items)
    assert any(r[2] is None for r in got(out)) and sum(r[2] == 9 for r in got(out)) == 2
    assert got(ranked.ranked(edge.empty(spark), frame)) == [] and got(ranked.ranked(docs, frame.where("false"))) == []
