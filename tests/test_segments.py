import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocks, segments, textindex
from lexmill.operators.segments import Segments
from lexmill.sources import tables

WORDS = [f"w{k}" for k in range(40)] + ["river", "lake", "stone"] * 6


def made(r, ids, size=60):
    return [(f"c{i:04d}", f"d{i // 3}", " ".join(r.choice(WORDS) for _ in range(r.randrange(1, size)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, text string")


def terms(spark, rows):
    return frame(spark, rows).select("chunk_id", "document_id", textindex.analysed(F.col("text")).alias("terms"))


def found(index, query, limit, **more):
    return [(r.chunk_id, r.document_id, r.score) for r in textindex.search(index, query, limit, **more).collect()]


QUERIES = ["river", "river lake", "river OR w7", "w1 OR w2^3 OR stone", "river nothing", "river OR nothing", "nothing"]
GRAMMAR = ['"river lake"', "river NOT lake", "w1*", "river AND (w3 OR w4)"]


def same(spark, index, rows, queries=(*QUERIES, *GRAMMAR)):
    whole, mine = textindex.TextIndex.build(frame(spark, rows)), index.text_index()
    for q in queries:
        assert found(mine, q, 7) == found(whole, q, 7), q
    assert index.n == len(rows)


def counted(spark, root):
    """Rows in all folders by kind."""
    return {name: sum(spark.read.parquet(f"{root}/{name}/{s}").count() for s in tables.children(spark, f"{root}/{name}")) for name in ("forward", "gone", "blocks")}


def test_changes_equal_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD", 30)  # several shards and blocks
    monkeypatch.setattr(blocks, "BLOCK", 4)
    r = random.Random(1)
    rows = {x[0]: x for x in made(r, range(90))}
    index = Segments.open(spark, f"{tmp_path}/i").changed(terms(spark, list(rows.values())))
    same(spark, index, list(rows.values()))
    more = made(r, range(90, 100))  # new ones
    index = index.changed(terms(spark, more))
    rows |= {x[0]: x for x in more}
    again = made(r, range(20, 26))  # changed texts
    index = index.changed(terms(spark, [*again, again[0]]))
    rows |= {x[0]: x for x in again}
    same(spark, index, list(rows.values()), QUERIES)
    index = index.changed(documents=spark.createDataFrame([("d8",), ("d31",), ("none",)], "document_id string"), chunks=spark.createDataFrame([("c0001",)], "chunk_id string"))
    rows = {k: x for k, x in rows.items() if x[1] not in ("d8", "d31") and k != "c0001"}
    same(spark, index, list(rows.values()))
    index = index.changed(terms(spark, made(r, [1])))  # one that was gone is back
    assert len(index.rows) < 5  # merged on the way
    index = Segments.open(spark, f"{tmp_path}/i")
    assert index.n == len(rows) + 1 and index.chunks().count() == index.n


def test_a_small_change_writes_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BASE", 50)
    r = random.Random(2)
    root = f"{tmp_path}/i"
    index = Segments.open(spark, root).changed(terms(spark, made(r, range(600))))
    before = counted(spark, root)
    index = index.changed(terms(spark, made(r, [5, 700, 701])))
    after = counted(spark, root)
    assert after["forward"] - before["forward"] == 3 and after["gone"] == 1 and after["blocks"] - before["blocks"] <= 3 * 60
    sizes = []
    for k in range(7):
        index = index.changed(terms(spark, made(r, range(710 + 3 * k, 713 + 3 * k), 5)))
        sizes.append(len(index.rows))
    assert max(sizes) <= 1 + segments.FANOUT and index.n == 602 + 21  # the large one is not touched by merges of small ones
    assert index.rows[0].chunks == 600
    assert {r.segment for r in index.rows} <= {s.removeprefix("segment=") for s in tables.children(spark, f"{root}/forward")}
    assert len(tables.children(spark, f"{root}/forward")) <= len(index.rows) + segments.FANOUT + 1


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/i"
    r = random.Random(3)
    rows = made(r, range(9))
    a = Segments.open(spark, root).changed(terms(spark, rows[:3]))
    b = Segments.open(spark, root)
    a = a.changed(terms(spark, rows[3:6]))
    b = b.changed(terms(spark, rows[6:]))  # from a list that is no longer the present one
    assert {x.chunk_id for x in Segments.open(spark, root).chunks().collect()} == {x[0] for x in rows}
    at = f"{tmp_path}/t"
    number, _ = tables.numbered(spark, at)
    assert number is None
    assert tables.publish(spark.range(1), at, base=-1) == 0
    with pytest.raises(tables.Conflict):
        tables.publish(spark.range(2), at, base=-1)
    seen = []

    def change(old):
        if not seen:  # another writer comes in between
            tables.publish(old.union(spark.range(10, 11)), at)
        seen.append(1)
        return old.union(spark.range(20, 21))

    tables.update(spark, at, change)
    assert {x.id for x in tables.read(spark, at).collect()} == {0, 10, 20} and len(seen) == 2
    (tmp_path / "t" / f"{tables.POINTER}.000000000099").write_bytes(b"")  # a writer that died at its pointer
    assert tables.read(spark, at).count() == 3


def test_pruned_searches_score_few_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    r = random.Random(4)
    rows = [(f"c{i:05d}", f"d{i}", " ".join(["river"] * r.choice([1, 1, 1, 2, 3]) + ["pebble"] * r.choice([0, 1, 1, 2]) + r.sample(WORDS, 3) + [f"x{r.randrange(5000)}" for _ in range(r.randrange(150))] + ["rare"] * (i % 300 == 7))) for i in range(3000)]
    index = Segments.open(spark, f"{tmp_path}/i").changed(terms(spark, rows))
    whole = textindex.TextIndex.build(frame(spark, rows)).terms.cache()
    whole = textindex.TextIndex(textindex.counted(whole), whole.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length")), terms=whole)
    for q, boosts, every in (("river pebble", {"river": 1.0, "pebble": 1.0}, True), ("river OR pebble OR rare", {"river": 1.0, "pebble": 1.0, "rare": 1.0}, False)):
        assert found(index.text_index(), q, 10) == found(whole, q, 10)
        s = index.by_blocks(boosts, every, 10)
        all_of_them = s.blocks.agg(F.sum("n")).first()[0]
        scored = sum(df.agg(F.sum("n")).first()[0] for df in (s.chosen(), s.final()))
        assert scored < all_of_them / 3, (q, scored, all_of_them)
    inside = spark.createDataFrame([(x[0],) for x in rows[::7]], "chunk_id string")
    assert found(index.text_index(), "river pebble", 10, inside=inside) == [x for x in found(whole, "river pebble", 3000) if int(x[0][1:]) % 7 == 0][:10]
    asked = spark.createDataFrame([(1, "river pebble"), (2, "w3 stone"), (3, "river missing"), (4, "")], "query_id long, text string")
    for every in (True, False):
        want = {tuple(x) for x in textindex.search_batch(whole, asked, 5, every).collect()}
        assert {tuple(x) for x in index.search_batch(asked, 5, every).top().collect()} == want


def test_empty(spark, tmp_path):
    index = Segments.open(spark, f"{tmp_path}/i")
    assert index.n == 0 and index.chunks().count() == 0 and found(index.text_index(), "river", 5) == []
    index = index.changed(terms(spark, [("c1", "d1", ""), ("c2", "d1", "the of")]))
    assert index.n == 2 and found(index.text_index(), "river", 5) == []
    index = index.changed(documents=spark.createDataFrame([("d1",)], "document_id string"))
    assert index.n == 0 and index.chunks().count() == 0


def test_bounds_hold(spark):
    r = random.Random(5)
    rows = made(r, range(200), 90)
    p = textindex.counted(terms(spark, rows), positions=True)
    b = blocks.blocked(p, 2)
    n, mean, df = F.lit(1000), F.lit(33.0), F.lit(17)
    with_bound = blocks.opened(b.withColumn("bound", blocks.bound(df, n, mean)))
    assert with_bound.where(textindex.bm25(F.col("tf"), F.col("length"), df, n, mean) > F.col("bound") + 1e-9).count() == 0
    assert with_bound.count() == p.count()
