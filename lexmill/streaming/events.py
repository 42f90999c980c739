"""Event streams: debounce, rate windows, subscriptions, scopes that expire. Each has a batch form with the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import metadata as M


def debounced(events: DataFrame, key: str, gap_seconds: int, time: str = "ts", payload: str = "event_type") -> DataFrame:
    """(key, first, last, events, payload): the last event of each run of events less than the gap apart. Batch form."""
    w = F.session_window(time, f"{gap_seconds} seconds")
    out = events.groupBy(key, w.alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"), F.max_by(payload, F.struct(time, payload)).alias(payload))
    return out.select(key, "first", "last", "events", payload)


def debounced_stream(events: DataFrame, key: str, gap_seconds: float, payload: str = "event_type") -> DataFrame:
    """The payload with the latest time of a key once no event has come for the gap, by processing time; ties to the larger payload. Emits once per burst.

    The rule is that of the batch form, whatever the micro-batches and the order in which events arrive.
    """
    kind = dict(events.dtypes)
    milliseconds = int(gap_seconds * 1000)

    def step(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], payload: [last], "events": [n]})
            return
        last, n, latest = state.get if state.exists else (None, 0, None)
        for part in rows:
            if len(part):
                end = part.sort_values(["ts", payload]).iloc[-1]
                at = end["ts"].value
                if latest is None or (at, end[payload]) >= (latest, last):
                    latest, last = at, end[payload]
                n += len(part)
        state.update((last, n, latest))
        state.setTimeoutDuration(milliseconds)

    return events.select(key, payload, "ts").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {payload} {kind[payload]}, events long", f"last {kind[payload]}, n long, latest long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def rate_windows(events: DataFrame, client: str, window: str = "1 minute", limit: int = 100, time: str = "ts", watermark: str | None = None) -> DataFrame:
    """(client, start, requests, limited): fixed windows of each client, and whether it is over the limit. Works on streams with a watermark."""
    if watermark:
        events = events.withWatermark(time, watermark)
    out = events.groupBy(client, F.window(time, window).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(client, F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("limited"))


def subscribed(events: DataFrame, subscription: dict | None) -> DataFrame:
    """Events that a subscription wants: all if it is empty; lists are IN, scalars equality."""
    return events.where(M.predicate(subscription, dict(events.dtypes)))


def active_scopes(scopes: DataFrame, now: Column) -> DataFrame:
    """Scopes (session_id, document_id, expires_at) that have not expired."""
    return scopes.where(F.col("expires_at") > now)


def micro_batches(events: DataFrame, size: int = 5, time: str = "ts", key: str = "event_id", buckets: Column | None = None) -> DataFrame:
    """Adds batch: events in order by up to ``size``, within each bucket (a day by default), so that no window holds the table."""
    bucket = F.to_date(time) if buckets is None else buckets
    n = F.row_number().over(Window.partitionBy(bucket).orderBy(time, key))
    return events.withColumn("batch", F.concat_ws("-", bucket.cast("string"), F.floor((n - 1) / size).cast("string")))


def dispatched(events: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """(key, action): created and modified files that still exist are upserted, deleted ones deleted; the rest is dropped."""
    there = events.join(existing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    kind = F.col("event_type")
    action = F.when(kind.isin("created", "modified") & F.col("_there"), "upsert").when(kind == "deleted", "delete")
    return there.withColumn("action", action).where("action is not null").select(key, "action")


#: The states of a job that is not over.
UNFINISHED = ("queued", "running")


def not_in_flight(events: DataFrame, jobs: DataFrame, key: str = "path") -> DataFrame:
    """Events of files for which no job is queued or running."""
    return events.join(jobs.where(F.col("status").isin(*UNFINISHED)).select(key).distinct(), key, "left_anti")


def counts_by_kind(events: DataFrame, kinds: list[str], column: str = "event_type") -> DataFrame:
    """(event_type, events) of each of the kinds that subscribers know, also of those without an event; other kinds are not told of."""
    known = F.broadcast(events.sparkSession.createDataFrame([(k,) for k in kinds], f"{column} string"))  # a short list
    counted = events.groupBy(column).agg(F.count("*").alias("events"))
    return known.join(counted, column, "left").select(column, F.coalesce("events", F.lit(0)).alias("events"))


def new_file_stream(spark: SparkSession, root: str, pattern: str = "*.md", per_trigger: int = 5) -> DataFrame:
    """New files below root as they come. Changes and deletions need a snapshot difference: a file source tells of additions only."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
