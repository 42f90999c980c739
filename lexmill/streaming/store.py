"""Streams that keep state of the store: changes applied to the text index, and events held back while a key is in flight."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import ids
from ..operators import textindex
from ..operators.segments import Segments
from ..sources import tables

UPSERTS, DELETES = ("created", "modified"), ("deleted",)


def lines(documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, text): a chunk for each line of documents (document_id, text)."""
    out = documents.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return out.select(ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text"), F.lit(None).cast("int")).alias("chunk_id"), "document_id", "text")


class IndexSink:
    """What foreachBatch calls with changes (document_id, event_type, text, ts): created and modified documents take the place of their chunks, deleted ones go.

    Of one document the last event of a batch counts (of equal times the larger kind, then text). A batch is one change of the index, and its number is noted after
    it: a batch that comes again is left alone, and one that was stopped between the two is made again with the same outcome, because
    a change puts documents in place of themselves. Other kinds and null ids are ignored. What a stream has applied is kept by its name.
    """

    def __init__(self, root: str, chunker: Callable[[DataFrame], DataFrame] = lines, analyzer: str = "standard", stream: str = "changes"):
        self.root, self.chunker, self.analyzer, self.stream = root, chunker, analyzer, stream

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        applied = tables.read(spark, f"{self.root}/applied")
        if applied is not None and applied.where((F.col("stream") == self.stream) & (F.col("batch") >= batch_id)).limit(1).count():
            return
        known = batch.where(F.col("document_id").isNotNull() & F.col("event_type").isin(*UPSERTS, *DELETES))
        last = known.groupBy("document_id").agg(F.max(F.struct("ts", "event_type", "text")).alias("e")).select("document_id", "e.event_type", "e.text").persist()
        try:
            if last.limit(1).count():
                new = self.chunker(last.where(F.col("event_type").isin(*UPSERTS)).select("document_id", F.coalesce("text", F.lit("")).alias("text")))
                terms = new.select("chunk_id", "document_id", textindex.analysed(F.col("text"), self.analyzer).alias("terms"))
                Segments.open(spark, f"{self.root}/text", self.analyzer).changed(terms, documents=last.select("document_id"))
        finally:
            last.unpersist()
        row = spark.createDataFrame([(self.stream, batch_id)], "stream string, batch long")
        tables.update(spark, f"{self.root}/applied", lambda old: row if old is None else old.where(F.col("stream") != self.stream).unionByName(row))

    def index(self, spark) -> textindex.TextIndex:
        return Segments.open(spark, f"{self.root}/text", self.analyzer).text_index()


STARTED, FINISHED = "started", "finished"


def _released(rows: pd.DataFrame, until: int | None, seconds: float) -> tuple[list[bool], int | None]:
    """Which of one key's rows, in order of time, go on, and until when (nanoseconds) the key is in flight after them."""
    out = []
    for at, kind in zip(rows["ts"].astype("int64").tolist(), rows["event_type"].tolist()):
        if until is not None and at >= until:
            until = None  # the job was lost
        if kind == FINISHED:
            until = None
            out.append(False)
            continue
        out.append(kind != STARTED and until is None)
        if kind == STARTED or out[-1]:
            until = at + int(seconds * 1e9)
    return out, until


def not_in_flight(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, event_type, ts) of the events that find their key idle. An event that goes on puts its key in flight, as ``started`` does, until ``finished`` comes or so many seconds passed. Batch form."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(ts=rows["ts"].astype("datetime64[ns]")).sort_values(["ts", "event_type"])
        return rows[_released(rows, None, seconds)[0]]

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_type", "ts").groupBy(key).applyInPandas(run, f"{key} {kind}, event_type string, ts timestamp")


def not_in_flight_stream(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """The same over a stream; the state of a key is in the checkpoint, so a restart neither repeats nor loses an event. Events of a key are taken in order of time within a batch, batches as they come."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        rows = rows.assign(ts=rows["ts"].astype("datetime64[ns]")).sort_values(["ts", "event_type"])
        on, until = _released(rows, state.get[0] if state.exists else None, seconds)
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
        yield rows[on]

    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, event_type string, ts timestamp"
    return events.select(key, "event_type", "ts").groupBy(key).applyInPandasWithState(step, schema, "until long", "append", GroupStateTimeout.NoTimeout)

