import os

from lexmill.llm import similar


def test_the_table_of_levels_leaves_the_driver(spark, monkeypatch):
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(real(self, value)) or sent[-1])
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are here now")], "doc_id long, text string").coalesce(1)
    fps, roots = similar.linked(docs)
    assert len(sent) == 1 and not os.path.exists(sent[0]._path)
    assert fps.count() == 3 and roots.count() == 0
