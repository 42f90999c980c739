"""Searches over a collection: vector, text, hybrid, reranked, scoped, similar, and what is built on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..sources import tables
from . import embedding, fusion, textindex, vectorsearch


@dataclass(frozen=True)
class Settings:
    vector_weight: float = 0.6
    text_weight: float = 0.4
    rrf_k: int = 60
    expansion: float = 2.0
    most_expanded: int = 30
    rerank_more: int = 5
    scope_threshold: int = 1000
    scope_documents: int = 50
    scope_seconds: int = 3600


@dataclass
class Collection:
    """chunks (chunk_id, document_id, text, chunk_index, page_number, embedding, metadata) and documents (document_id, path, title, metadata, added_at)."""

    chunks: DataFrame
    documents: DataFrame
    index: textindex.TextIndex | None = None
    embed: Callable[[str], list[float]] | None = None
    settings: Settings = field(default_factory=Settings)


def validated(query: str, limit: int, min_score: float) -> None:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must lie between 0 and 1")


def allowed(c: Collection, where: dict | None) -> Column | None:
    """The filter as a condition on chunks; document metadata is looked up first, then the chunk's."""
    if not where:
        return None
    return M.predicate(where, {x: t for x, t in c.chunks.dtypes if x not in ("metadata", "embedding", "document_metadata")}, *[F.col(x) for x in ("document_metadata", "metadata") if x in c.chunks.columns])


def enriched(c: Collection, hits: DataFrame, search_type: str, limited: bool = True) -> DataFrame:
    """Hits (chunk_id, score, ...) with the chunk's and its document's columns. Those of a search are few (``limited``) and broadcast; others are joined as Spark sees fit."""
    small = F.broadcast if limited else lambda df: df
    own = c.chunks.select("chunk_id", "document_id", "chunk_index", "page_number", "text")
    out = own.join(small(hits.drop("document_id")), "chunk_id")
    docs = c.documents.select("document_id", "path", "title")
    rows = docs.join(small(out), "document_id", "right")
    return rows.withColumn("search_type", F.lit(search_type))


def vector_arm(c: Collection, vector: list[float], limit: int, where: dict | None = None, min_score: float = 0.0) -> DataFrame:
    hits = vectorsearch.search(c.chunks, vector, limit, allowed(c, where), min_score)
    return fusion.ranked(hits.select("chunk_id", "distance", "score"), "distance", "chunk_id")


def text_arm(c: Collection, query: str, limit: int, where: dict | None = None, min_score: float = 0.0) -> DataFrame:
    index = c.index or textindex.TextIndex.build(c.chunks)
    if where:  # before ranking, as for vectors; statistics stay those of the whole collection
        hits = textindex.search(index, query, limit, None, min_score, c.chunks.where(allowed(c, where)).select("chunk_id"), c.chunks)
    else:
        hits = textindex.search(index, query, limit, None, min_score, chunks=c.chunks)
    return fusion.ranked(hits, F.desc("score"), "chunk_id")


def search(
    c: Collection,
    query: str,
    limit: int = 5,
    where: dict | None = None,
    search_type: str = "hybrid",
    min_score: float = 0.0,
    vector: list[float] | None = None,
    rerank: Callable[[Column, str], Column] | None = None,
) -> DataFrame:
    """The best chunks, best first, with scores, document columns and search_type.

    Without an embedder a hybrid search is a text search; without texts to index it is a vector search. ``min_score`` is compared in
    each arm with that arm's own score. A reranker rescores limit + 5 candidates.
    """
    validated(query, limit, min_score)
    if search_type not in ("hybrid", "vector", "text"):
        raise ValueError(f"unknown search type {search_type!r}")
    s = c.settings
    wide = limit + s.rerank_more if rerank else limit
    if search_type != "text" and vector is None:
        vector = c.embed(query) if c.embed else None
        if vector is None:
            search_type = "text"
    if search_type == "vector":
        hits = vector_arm(c, vector, wide, where, min_score).select("chunk_id", "score", "rank", F.col("score").alias("vector_score"), F.lit(None).cast("double").alias("text_score"))
    elif search_type == "text":
        hits = text_arm(c, query, wide, where, min_score).select("chunk_id", "score", "rank", F.lit(None).cast("double").alias("vector_score"), F.col("score").alias("text_score"))
    else:
        n = fusion.expanded_limit(wide, s.expansion, s.most_expanded)
        fused = fusion.reciprocal_rank_fusion(
            vector_arm(c, vector, n, where, min_score), text_arm(c, query, n, where, min_score), wide, s.vector_weight, s.text_weight, s.rrf_k
        )
        hits = fusion.ranked(fused, F.desc("score"), "chunk_id")
    rows = enriched(c, hits, search_type)
    if rerank:
        rows = embedding.reranked(rows, rerank(F.col("text"), query), limit)
    return rows.repartition(1).sortWithinPartitions("rank")  # few rows: a global sort would run the plan once more to sample them


def coarse_documents(c: Collection, query: str, k: int, vector: list[float] | None = None) -> DataFrame:
    """The first k documents (document_id, rank) in the rank order of their best chunk: by text, or by vector if no text matches."""
    index = c.index or textindex.TextIndex.build(c.chunks)
    hits = fusion.ranked(textindex.search(index, query, min(100, 10 * k), chunks=c.chunks), F.desc("score"), "chunk_id").select("document_id", "rank")
    if vector is not None and not hits.limit(1).count():
        hits = vector_arm(c, vector, min(2 * k, 20)).join(c.chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id", "rank")
    return hits.groupBy("document_id").agg(F.min("rank").alias("rank")).orderBy("rank").limit(k)


class Scopes:
    """Session scopes: document ids with the time at which they expire."""

    def __init__(self, seconds: int = 3600):
        self.seconds, self.kept = seconds, {}

    def get(self, session: str, now: float) -> list[str] | None:
        ids, until = self.kept.get(session, (None, 0))
        return ids if ids is not None and now < until else None

    def put(self, session: str, ids: list[str], now: float) -> None:
        self.kept[session] = (list(ids), now + self.seconds)


class StoredScopes(Scopes):
    """Scopes in a table (session_id, document_ids, expires_at) of a store, which all drivers share; expired ones go with the next write."""

    def __init__(self, spark: SparkSession, root: str, seconds: int = 3600):
        super().__init__(seconds)
        self.spark, self.root = spark, root

    def get(self, session: str, now: float) -> list[str] | None:
        rows = tables.read(self.spark, self.root)
        row = rows.where((F.col("session_id") == session) & (F.col("expires_at") > now)).first() if rows is not None else None
        return list(row.document_ids) if row is not None else None

    def put(self, session: str, ids: list[str], now: float) -> None:
        row = self.spark.createDataFrame([(session, list(ids), now + self.seconds)], "session_id string, document_ids array<string>, expires_at double")
        tables.update(self.spark, self.root, lambda old: row if old is None else old.where((F.col("session_id") != session) & (F.col("expires_at") > now)).unionByName(row))


def scoped_search(c: Collection, query: str, session: str, scopes: Scopes, now: float, limit: int = 5, where: dict | None = None, **more) -> DataFrame:
    """A search within the session's documents if the collection is large; a new session's are those of its first query."""
    s = c.settings
    if c.documents.select("document_id").limit(s.scope_threshold).count() >= s.scope_threshold:  # no count of all
        ids = scopes.get(session, now)
        if ids is None:
            vector = more.get("vector")
            ids = [r.document_id for r in coarse_documents(c, query, s.scope_documents, vector).collect()]  # at most scope_documents
            scopes.put(session, ids, now)
        if ids:
            scope = {"document_id": {"$in": ids}}
            where = {"$and": [where, scope]} if where else scope
    return search(c, query, limit, where, **more)


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of the documents in scope (document_id), however many they are."""
    return rows.join(scope.select("document_id").distinct(), "document_id", "left_semi")


def page(results: DataFrame, size: int, token: str | None = None, total: int | None = None) -> tuple[DataFrame, str | None]:
    """One page of ordered results and the token of the next (its offset), null after the last."""
    start = int(token) if token else 0
    total = results.count() if total is None else total
    return results.offset(start).limit(size), str(start + size) if start + size < total else None


def similar_documents(c: Collection, document_id: str, limit: int = 5, search_type: str = "hybrid", **more) -> DataFrame:
    """Chunks of other documents like this one's title, or the first 200 characters of its first chunk."""
    row = c.documents.where(F.col("document_id") == document_id).select("title").first()
    if row is None:
        raise KeyError(document_id)
    query = row.title
    if not query:
        first = c.chunks.where((F.col("document_id") == document_id) & (F.col("chunk_index") == 0)).select(F.left("text", F.lit(200)).alias("t")).first()
        query = first.t if first else ""
    found = search(c, query, limit + 1, {"document_id": {"$ne": document_id}}, search_type, 0.1, **more)
    return found.where(F.col("rank") <= limit)


#: Phrases that are suggested after a fragment.
PATTERNS = ("overview", "introduction", "summary", "definition", "examples")


def suggestions(documents: DataFrame, fragment: str, limit: int = 10) -> DataFrame:
    """(suggestion, rank): title words longer than three letters that hold the fragment, by frequency, then phrases."""
    words = documents.select(F.explode(F.split(F.lower("title"), r"\s+")).alias("w")).where((F.length("w") > 3) & F.contains(F.col("w"), F.lit(fragment.lower())))
    best = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(limit)
    best = best.select(F.concat(F.upper(F.substring("w", 1, 1)), F.substring(F.col("w"), F.lit(2), F.length("w"))).alias("suggestion"), F.lit(0).alias("kind"), (-F.col("n")).alias("at"))
    spark = documents.sparkSession
    phrases = spark.createDataFrame([(f"{fragment} {p}", 1, k) for k, p in enumerate(PATTERNS)], "suggestion string, kind int, at long")
    every = best.unionByName(phrases).groupBy("suggestion").agg(F.min(F.struct("kind", "at")).alias("o"))
    rank = F.row_number().over(Window.orderBy("o.kind", "o.at", "suggestion"))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit).select("suggestion", "rank")
