"""Embedders, rerankers and summarisers behind small interfaces, with deterministic defaults that need no model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions import vector as V
from .batches import bounded

#: A callable from texts to vectors, run in batches inside a worker.
Embedder = Callable[[list[str]], list[list[float]]]


def hashed(text: Column, dimensions: int = 64) -> Column:
    """Feature hashing, in the JVM: each token adds 1 or -1 at a place given by its MD5; scaled to length 1."""
    digest = lambda t: F.md5(t.cast("binary"))
    place = lambda t: (F.conv(F.substring(digest(t), 1, 6), 16, 10).cast("long") % dimensions).cast("int")
    sign = lambda t: F.when(F.conv(F.substring(digest(t), 7, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    placed = F.transform(T.tokens(text), lambda t: F.struct(place(t).alias("i"), sign(t).alias("s")))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda d: F.aggregate(F.filter(placed, lambda p: p["i"] == d), F.lit(0.0), lambda a, p: a + p["s"]),
    )
    return F.when(F.size(T.tokens(text)) > 0, V.normalised(raw))


#: Tokens whose places a worker keeps.
KNOWN = 50_000


def with_hashed(rows: DataFrame, dimensions: int = 64, text: bool = True) -> DataFrame:
    """rows (text, ...) with an embedding like hashed()'s: tokens are made in the JVM, hashed in Arrow batches, and nothing is shuffled. Without text that column neither goes to Python nor comes back."""
    given = rows.withColumn("_tokens", T.tokens(F.col("text")))
    rows, given = (rows, given) if text else (rows.drop("text"), given.drop("text"))
    names = rows.columns

    def run(batches):
        known: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if len(known) > KNOWN:
                known.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            out = known[token] = int(digest[:6], 16) % dimensions, 1.0 if int(digest[6], 16) % 2 == 0 else -1.0
            return out

        for b in batches:
            lists = b.column(b.num_columns - 1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()  # each different token of the batch is hashed once
            places = [known.get(t) or place(t) for t in coded.dictionary.to_pylist()]
            at = np.repeat(np.arange(b.num_rows), lengths) * dimensions
            if places:
                codes = coded.indices.to_numpy()
                i, s = np.array([x[0] for x in places], dtype=np.int64)[codes], np.array([x[1] for x in places])[codes]
                raw = np.bincount(at + i, weights=s, minlength=b.num_rows * dimensions).reshape(b.num_rows, dimensions)
            else:
                raw = np.zeros((b.num_rows, dimensions))
            n = np.sqrt((raw * raw).sum(axis=1))
            unit = (raw / np.where(n > 0, n, 1.0)[:, None]).astype(np.float32)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * dimensions
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()), mask=pa.array(lengths == 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], [*names, "embedding"])

    schema = T_.StructType([*rows.schema.fields, T_.StructField("embedding", T_.ArrayType(T_.FloatType()))])
    return bounded(given).mapInArrow(run, schema)


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = 32, cache: DataFrame | None = None) -> DataFrame:
    """chunks with an embedding column: each different text is embedded once, and not at all if a cache (text_hash, embedding) has it.

    A batch that fails leaves nulls, so that its documents are kept without vectors.
    """

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                part = list(s[at : at + batch])
                try:
                    out += [list(map(float, v)) for v in embedder(part)]
                except Exception:  # an embedder may fail in any way
                    out += [None] * len(part)
            yield pd.Series(out)

    keyed = chunks.withColumn("text_hash", F.md5(F.col("text").cast("binary")))
    texts = keyed.groupBy("text_hash").agg(F.first("text").alias("text"))
    if cache is not None:
        texts = texts.join(cache.select("text_hash"), "text_hash", "left_anti")
    new = texts.select("text_hash", embed("text").alias("embedding"))
    known = new if cache is None else new.unionByName(cache.select("text_hash", "embedding"))
    return keyed.join(known, "text_hash", "left").drop("text_hash")


def retrying(embedder: Embedder, tries: int = 3, base_seconds: float = 1.0, pause_seconds: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """An embedder that is asked again after base, 2 * base, ... seconds, with a pause before every batch but the first."""
    state = {"called": False}

    def run(texts: list[str]) -> list[list[float]]:
        if state["called"] and pause_seconds:
            sleep(pause_seconds)
        state["called"] = True
        for attempt in range(tries):
            try:
                return embedder(texts)
            except Exception:  # a service may fail in any way
                if attempt == tries - 1:
                    raise
                sleep(base_seconds * 2**attempt)
        raise AssertionError("unreachable")

    return run


def halving(embedder: Embedder) -> Embedder:
    """An embedder that is given half a batch at a time when memory runs out."""

    def run(texts: list[str]) -> list[list[float]]:
        try:
            return embedder(texts)
        except MemoryError:
            if len(texts) < 2:
                raise
            half = len(texts) // 2
            return run(texts[:half]) + run(texts[half:])

    return run


def one_by_one(embed: Callable[[str], list[float]]) -> Embedder:
    """An embedder for a service that takes one text a call."""
    return lambda texts: [embed(t) for t in texts]


#: Entries that an embedding cache keeps.
CACHED = 10_000


def latest_used(cache: DataFrame, most: int = CACHED) -> DataFrame:
    """The entries (text_hash, embedding, used) of a cache that were used last; ties to the smaller hash."""
    return cache.orderBy(F.desc("used"), "text_hash").limit(most)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def registered(name: str, fallback: str | None = None) -> Embedder:
    """An embedder by name, or the fallback's if there is none."""
    make = EMBEDDERS.get(name) or (EMBEDDERS.get(fallback) if fallback else None)
    if make is None:
        raise KeyError(f"no embedder {name!r}")
    return make()


def with_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks that have an embedding; the others are not stored."""
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def yes_probability(yes: Column, no: Column) -> Column:
    """The probability of yes from two logits; 0 if it is not a number."""
    return F.coalesce(F.nanvl(1 / (1 + F.exp(no - yes)), F.lit(0.0)), F.lit(0.0))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def overlap(text: Column, query: str) -> Column:
    """The default reranker's score: the share of the query's different tokens that a text has."""
    words = F.array_distinct(T.tokens(F.lit(query)))
    return F.coalesce(F.size(F.array_intersect(F.array_distinct(T.tokens(text)), words)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def reranked(candidates: DataFrame, score: Column | None, limit: int, id_column: str = "chunk_id") -> DataFrame:
    """Candidates (rank, ...) by a new score; without one (a reranker that failed) in their order with score 1."""
    scored = candidates.withColumn("score", F.round(F.coalesce(clamped(score), F.lit(1.0)), 6) if score is not None else F.lit(1.0))
    out = scored.withColumn("search_type", F.lit("reranked")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank", id_column)))
    return out.where(F.col("rank") <= limit)


Summariser = Callable[[str, str], dict]


def accepted_title(summary_title: Column, title: Column) -> Column:
    return F.when(F.length(summary_title) > 5, summary_title).otherwise(title)


def parsed_summary(response: Column) -> Column:
    """The summary in a response: title, short and long description, cut to 80, 200 and 500; null if one is missing or blank."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    raw = F.from_json(F.when(body != "", body).otherwise(response), "title string, short_description string, long_description string")
    parts = {k: T.stripped(raw[k]) for k in ("title", "short_description", "long_description")}
    good = (parts["title"] != "") & (parts["short_description"] != "") & (parts["long_description"] != "")
    cut = {"title": 80, "short_description": 200, "long_description": 500}
    return F.when(good, F.struct(*[F.left(parts[k], F.lit(n)).alias(k) for k, n in cut.items()]))


#: The wording of a summary that no model wrote.
SHORT_FALLBACK = "Document with %d words"
LONG_FALLBACK = (
    "This document contains %d words and %d characters. Automatic summarization was not available, but the document appears to contain structured content suitable for analysis."
)


def fallback_summary(text: Column, filename: Column) -> Column:
    words, chars = T.word_count(text), F.length(text)
    title = F.when(F.coalesce(filename, F.lit("")) != "", F.initcap(F.regexp_replace(F.replace(filename, F.lit(".pdf"), F.lit("")), "_", " "))).otherwise("Document")
    return F.struct(
        title.alias("title"),
        F.format_string(SHORT_FALLBACK, words).alias("short_description"),
        F.format_string(LONG_FALLBACK, words, chars).alias("long_description"),
    )


def summarised(documents: DataFrame, content: Column, summariser: Summariser) -> DataFrame:
    """documents (document_id, filename, title, ...) with a summary struct by a callable(content, filename); null where it fails or content is short."""

    @F.pandas_udf("title string, short_description string, long_description string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in parts:
            rows = []
            for text, name in zip(texts, names):
                try:
                    rows.append(summariser(text, name) if text is not None and len(text.strip()) >= 100 else {})
                except Exception:  # a summariser may fail in any way
                    rows.append({})
            yield pd.DataFrame([{k: r.get(k) for k in ("title", "short_description", "long_description")} for r in rows], columns=["title", "short_description", "long_description"])

    out = documents.withColumn("summary", run(content, F.col("filename")))
    return out.withColumn("title", accepted_title(F.col("summary.title"), F.col("title")))
