"""The near-duplicate stage: SimHash comes first, its links are confirmed, and what it connects is settled."""

import random

import pytest

from lexmill.llm import simhash, similar

from .test_similar import brute_kept, edited


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that the stage writes, by name."""
    out, real = {}, similar.saved

    def saved(df, name, *rest):
        table = real(df, name, *rest)
        out[name] = table.collect()
        return table

    monkeypatch.setattr(similar, "saved", saved)
    return out


def kept(docs):
    return {x.doc_id for x in simhash.deduplicated(docs).select("doc_id").collect()}


def test_what_simhash_connects_is_settled(spark, written, monkeypatch):
    asked, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *rest: asked.append(fps.count()) or real(fps, *rest))
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join([*words[:-1], "end"]), " ".join(words)]  # one word in 3,000
    apart = [bin(simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(t.encode())).count("1") for t in texts]
    assert max(apart) <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert kept(docs) == {0}
    assert asked == [2] and len(written["simhash-links"]) == 1
    assert written["hubs"] == [] and written["star"] == []


def test_links_of_simhash_are_confirmed(spark, written, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, *rest: 7)  # every text links to every other
    r = random.Random(8)
    rows = []
    for k in range(12):
        own = [f"{k}x{j}" for j in range(60)]
        rows += [" ".join(own), edited(r, own, 1), edited(r, own, 20)]
    rows = list(enumerate(rows))
    assert kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_kept(rows)


def test_copies_are_counted_once(spark, written):
    """Copies in several tasks were shingles of several texts, and all of them candidates, with their sets."""
    rows = [(i, " ".join(f"{i % 20}x{j}" for j in range(50))) for i in range(200)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == set(range(20))
    assert written["candidates"] == []
    assert all("part" not in r for r in written["signatures"])  # shingles are not written


def test_copies_without_an_id_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{j}" for j in range(30)) for k in "abc")
    rows = [(1, a), (9, a), (9, b), (None, b), (None, c), (4, c), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = similar.fingerprinted(docs)
    assert [x.doc_id for x in similar.copies(first).collect()] == []  # 9 has a text that no other id has
    fps, roots = similar.linked(docs)
    assert roots.count() == 0 and fps.count() == len(rows)
