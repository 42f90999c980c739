"""Exact nearest neighbours of query vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .batches import bounded

DECIMALS = 6
#: Queries that search_batch broadcasts, or holds in one block; vectors of one stripe.
BLOCK = 1024
STRIPE = 65_536


def search(vectors: DataFrame, query: list[float], limit: int = 5, where: Column | None = None, min_score: float = 0.0, id_column: str = "chunk_id") -> DataFrame:
    """The nearest rows of vectors (id, embedding, ...) with distance and score, min_score after the limit.

    Rows without a vector, or with one of another length, take no part. The best rows of each
    partition are merged, so no more than ``limit`` of each leave their task.
    """
    fit = F.col("embedding").isNotNull() & (F.size("embedding") == len(query))
    rows = vectors.where(fit if where is None else fit & where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    exact = rows.withColumn("distance", V.squared_l2(F.col("embedding"), literal))
    scored = exact.withColumns({"score": F.round(V.similarity(F.col("distance")), DECIMALS), "distance": F.round("distance", DECIMALS)})
    return scored.orderBy("distance", id_column).limit(limit).where(F.col("score") >= min_score)


class Nearest:
    """The best rows of each query so far, from blocks of vectors."""

    def __init__(self, names: list, queries: np.ndarray, limit: int):
        self.names, self.q, self.limit = names, queries, limit
        self.square = (queries * queries).sum(axis=1)
        self.best: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in names]

    def add(self, ids: list, c: np.ndarray) -> None:
        raw = np.maximum(0.0, self.square[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (self.q @ c.T))
        d = np.round(raw, DECIMALS)  # ranks by rounded distances, so that equal vectors tie
        n = min(self.limit, len(ids))
        cut = np.partition(d, n - 1, axis=1)[:, n - 1] if n else np.zeros(len(self.names))
        for k, (dist, named) in enumerate(self.best):
            at = np.nonzero(d[k] <= cut[k])[0]
            dist = np.concatenate([dist, raw[k][at]])
            named = named + [ids[i] for i in at]
            order = sorted(range(len(named)), key=lambda i: (round(dist[i], DECIMALS), named[i]))[: self.limit]
            self.best[k] = (dist[order], [named[i] for i in order])

    def rows(self) -> dict[str, list]:
        found = [(self.names[k], i, float(x)) for k, (dist, named) in enumerate(self.best) for x, i in zip(dist, named)]
        return {"query_id": [r[0] for r in found], "id": [r[1] for r in found], "distance": [r[2] for r in found]}


def search_batch(vectors: DataFrame, queries: DataFrame, limit: int = 5, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, rank, id, score) for each of queries (query_id, embedding), by matrix products.

    Up to ``BLOCK`` queries are broadcast, and each task keeps its best rows only. More are cut into blocks, and the vectors into stripes of
    ``STRIPE``; each task searches one block in one stripe, all in one plan. Vectors of another length than a query's take no part.
    """
    rows = vectors.where("embedding is not null").select(F.col(id_column).alias("id"), "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    n = asked.count()
    kind, qkind = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    schema = f"query_id {qkind}, id {kind}, distance double"
    out = _sent(rows, asked, limit, schema) if n <= BLOCK else _striped(rows, asked, n, limit, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", DECIMALS), "id"))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "id", F.round(V.similarity(F.col("distance")), DECIMALS).alias("score"))


def _sent(rows: DataFrame, asked: DataFrame, limit: int, schema: str) -> DataFrame:
    by_length: dict[int, list] = {}
    for r in asked.collect():  # at most BLOCK
        by_length.setdefault(len(r[1]), []).append(r)
    sent = rows.sparkSession.sparkContext.broadcast([([r[0] for r in g], np.array([r[1] for r in g], dtype=np.float64)) for g in by_length.values()])

    def run(batches):
        best = [Nearest(names, q, limit) for names, q in sent.value]
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.diff(values.offsets.to_numpy())
            for b in best:
                d = b.q.shape[1]
                if (lengths == d).all():
                    c, own = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), d), ids
                else:
                    at = np.nonzero(lengths == d)[0].tolist()
                    c, own = np.array([values[i].as_py() for i in at], dtype=np.float64).reshape(len(at), d), [ids[i] for i in at]
                if own:
                    b.add(own, c)
        for b in best:
            found = b.rows()
            if found["id"]:
                yield pa.RecordBatch.from_pydict(found)

    return bounded(rows).mapInArrow(run, schema)


def _striped(rows: DataFrame, asked: DataFrame, n: int, limit: int, schema: str) -> DataFrame:
    blocks, stripes = -(-n // BLOCK), max(1, -(-rows.count() // STRIPE))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("block", place("query_id", blocks)).withColumn("stripe", each(stripes))
    # a column of its own name: both sides may come from one table
    right = rows.select("id", F.col("embedding").alias("vector"), place("id", stripes).alias("stripe"), each(blocks).alias("block"))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [{"query_id": [], "id": [], "distance": []}]
        if not len(q) or not len(c):  # a side without rows has no columns
            return pd.DataFrame(out[0])
        lengths = c["vector"].map(len).astype("int64")
        for d, part in q.groupby(q["embedding"].map(len).astype("int64")):
            own = c[(lengths == d).to_numpy()]
            best = Nearest(part["query_id"].tolist(), np.stack(part["embedding"].to_numpy()).astype(np.float64), limit)
            for at in range(0, len(own), 1024):
                some = own.iloc[at : at + 1024]
                best.add(some["id"].tolist(), np.stack(some["vector"].to_numpy()).astype(np.float64))
            out.append(best.rows())
        return pd.DataFrame({k: [x for o in out for x in o[k]] for k in out[0]})

    return left.groupBy("block", "stripe").cogroup(right.groupBy("block", "stripe")).applyInPandas(run, schema)
