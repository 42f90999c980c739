import random

from pyspark.sql import functions as F

from lexmill.operators import textindex
from lexmill.streaming import store
from lexmill.streaming.store import IndexSink

SCHEMA = "document_id string, event_type string, text string, ts timestamp"


def changes(r, n):
    rows = []
    for t in range(n):
        doc = f"d{r.randrange(12)}"
        kind = r.choice(["created", "modified", "modified", "deleted", "opened"])
        rows.append((doc, kind, None if kind == "deleted" else "\n".join(" ".join(r.choice(["river", "lake", "stone", "moss"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 3))), t))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, event_type string, text string, at long").select("document_id", "event_type", "text", F.timestamp_seconds("at").alias("ts"))


def found(index, query):
    return [(r.chunk_id, r.score) for r in textindex.search(index, query, 9).collect()]


def left(rows):
    docs = {}
    for doc, kind, text, _ in rows:
        if kind in store.UPSERTS:
            docs[doc] = text
        elif kind == "deleted":
            docs.pop(doc, None)
    return docs


def test_a_stream_stopped_and_started_again_equals_a_new_index(spark, tmp_path):
    r = random.Random(5)
    parts = [changes(r, 10), [(d, k, t, at + 10) for d, k, t, at in changes(r, 10)]]
    source, sink = f"{tmp_path}/source", IndexSink(f"{tmp_path}/store")
    for k, part in enumerate(parts):  # one run of the query for each
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        stream.awaitTermination()
        want = left([x for p in parts[: k + 1] for x in p])
        chunks = store.lines(spark.createDataFrame(list(want.items()), "document_id string, text string"))
        whole = textindex.TextIndex.build(chunks)
        for q in ("river", "lake OR moss", "stone moss"):
            assert found(sink.index(spark), q) == found(whole, q), (k, q)
    before = [x.segment for x in sink.index(spark).segments.rows]
    sink(frame(spark, [("d1", "deleted", None, 99)]), 1)  # a batch that was applied
    assert [x.segment for x in sink.index(spark).segments.rows] == before
    sink(frame(spark, [(None, "deleted", None, 99), ("d1", "opened", None, 99)]), 2)  # nothing to do
    assert [x.segment for x in sink.index(spark).segments.rows] == before


def test_in_flight_keys_across_a_restart(spark, tmp_path):
    rows = [("a", "modified", 0), ("a", "modified", 1), ("a", "finished", 2), ("a", "deleted", 3), ("b", "started", 0), ("b", "created", 1), ("b", "created", 200), ("c", "created", 5)]
    later = [("a", "modified", 4), ("a", "finished", 6), ("a", "modified", 7), ("b", "modified", 210), ("c", "finished", 6), ("c", "modified", 8), ("c", "modified", 9)]
    make = lambda x: spark.createDataFrame(x, "path string, event_type string, at long").select("path", "event_type", F.timestamp_seconds("at").alias("ts"))
    plain = lambda df: sorted((x.path, x.event_type, x.ts.timestamp()) for x in df.collect())
    want = plain(store.not_in_flight(make(rows + later), "path", 100))
    assert [(p, k, int(t)) for p, k, t in want] == [("a", "deleted", 3), ("a", "modified", 0), ("a", "modified", 7), ("b", "created", 200), ("c", "created", 5), ("c", "modified", 8)]
    source, out = f"{tmp_path}/source", f"{tmp_path}/out"
    for part in (rows, later):
        make(part).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema("path string, event_type string, ts timestamp").parquet(source)
        query = store.not_in_flight_stream(events, "path", 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert plain(spark.read.parquet(out)) == want
