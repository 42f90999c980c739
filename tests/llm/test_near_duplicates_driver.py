"""The near-duplicate stage: the tables of levels are written by tasks and read by workers, not brought to the driver."""

import pickle

import numpy as np

from lexmill.llm import similar


def test_the_tables_of_levels_do_not_come_to_the_driver(spark, monkeypatch):
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or real(self, value))
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g i")], "doc_id long, text string").repartition(2)
    got, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: got.append(collect(self)) or got[-1])
    fps, roots = similar.linked(docs, 0.6)
    assert sent and max(sent) < 10_000
    assert got and len(pickle.dumps(got)) < 10_000
    assert fps.count() == 2 and roots.count() == 2


def test_written_levels_are_read_whole(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i // 4 if j < 99 else i}x{j}" for j in range(200))) for i in range(40)], "doc_id long, text string").repartition(5)
    rows = [x.text.encode() for x in docs.collect()]
    shingles = similar.Shingles()
    sets = [shingles(t) for t in rows]
    for bits in (1, 6, 12):
        ranges = similar.Ranges(bits)
        level = similar.Levels(similar.levels(similar.counted(docs, ranges), ranges)._lexmill_path)
        hashes, times = np.unique(np.concatenate([x for _, x in {similar.signature(s): s for s in sets}.items()]), return_counts=True)
        got = level(hashes)
        assert (got[times > 1] > 0).all() and (times > 1).any()
        assert (got[times > 1] >= np.floor(np.log2(times[times > 1])) + 1).all()
        assert np.count_nonzero(got[times == 1]) < 0.01 * len(hashes)
