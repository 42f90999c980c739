"""A stored vector collection in cells, and searches that read the cells which can matter.

Centroids are fitted by k-means on at most ``SAMPLE`` vectors of each length, those of the smallest hash of id; every vector is then put into the cell of its nearest
centroid, with its distance to it. An insert puts new vectors into the cells there are and writes those alone, as one more part; what is there is not
rewritten. Vectors of a length that the sample has not seen are in a cell without a centroid, which is always read.

A query is searched in its nearest cells first, until they hold ``limit`` vectors; the ``limit``-th best distance so far bounds the rest: no vector of a cell is
nearer than the centroid less the cell's radius (triangle inequality), so only cells within the bound are read. The rows are those of comparing with
every vector. With ``probes`` only so many nearest cells are read, and rows may be missing: recall is measured in the tests.

What is broadcast are the centroids, at most ``MOST`` of each length. A cell is cut into parts of about ``PART`` vectors, queries into blocks of about ``QUERIES``, and a part goes
to those blocks only that need its cell. Null vectors and null ids take no part; of rows with one id the smallest vector counts; of ids that are stored already the stored one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..sources import tables
from .batches import bounded
from .vectorsearch import DECIMALS, Nearest

SAMPLE = 16_384
MOST = 4096
ROUNDS = 8
PART = 32_768
QUERIES = 4096
SPREAD = 8
#: Distances are ranked as rounded, so bounds this far beyond are still looked at.
MARGIN = 1e-5
UNKNOWN = -1


def k_means(rows: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centroids at most of rows, from evenly spaced rows by their first coordinates."""
    rows = np.unique(rows, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = distances(rows, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


class VectorCells:
    """The collection in a folder: cells (cell, centroid), parts of vectors (id, embedding, cell, away)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.number, listed = tables.numbered(spark, f"{root}/list")
        self.parts = [r.part for r in listed.collect()] if listed is not None else []  # a row for each insert
        self.centroids: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: numbers, centroids
        if tables.current(spark, f"{root}/cells"):
            known = [(r.cell, list(r.centroid)) for r in tables.read(spark, f"{root}/cells").collect()]  # at most MOST of each length
            for d in {len(c) for _, c in known}:
                own = sorted((cell, c) for cell, c in known if len(c) == d)
                self.centroids[d] = (np.array([cell for cell, _ in own]), np.array([c for _, c in own], dtype=np.float64))

    @staticmethod
    def build(vectors: DataFrame, root: str, id_column: str = "chunk_id", cells: int | None = None) -> VectorCells:
        """Fits cells (about the square root of the vectors' number) and stores vectors (id, embedding)."""
        spark = vectors.sparkSession
        rows = _fine(vectors, id_column)
        sizes = {r.d: r.n for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("d > 0").collect()}  # a row for each length
        out, number = [], 0
        for d, n in sorted(sizes.items()):
            sample = rows.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["embedding"]
            sample = np.array(sample.tolist(), dtype=np.float64)
            for c in k_means(sample, min(MOST, max(1, len(sample) // 4), cells or int(n**0.5) or 1)):
                out.append((number, c.tolist()))
                number += 1
        tables.publish(spark.createDataFrame(out, "cell int, centroid array<double>").coalesce(1), f"{root}/cells")
        return VectorCells(spark, root).inserted(vectors, id_column)

    def inserted(self, vectors: DataFrame, id_column: str = "chunk_id") -> VectorCells:
        """The collection with the vectors whose ids it does not have."""
        out = self
        while True:
            rows = _fine(vectors, id_column)
            if out.parts:
                rows = rows.join(out.vectors().select("id"), "id", "left_anti")
            part = f"p-{uuid.uuid4().hex}"
            kind = dict(rows.dtypes)["id"]
            put = bounded(rows).mapInArrow(_assign(self.spark.sparkContext.broadcast(out.centroids)), f"id {kind}, embedding array<double>, cell int, away double")
            put.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("cell", "away").write.parquet(f"{self.root}/vectors/part={part}")
            listed = self.spark.createDataFrame([(p,) for p in [*out.parts, part]], "part string").coalesce(1)
            try:
                tables.publish(listed, f"{self.root}/list", base=-1 if out.number is None else out.number)
                return VectorCells(self.spark, self.root)
            except tables.Conflict:  # another insert came first: what it brought is there now
                out = VectorCells(self.spark, self.root)

    def vectors(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/vectors").parquet(*[f"{self.root}/vectors/part={p}" for p in self.parts]).drop("part")

    def sizes(self) -> DataFrame:
        """(cell, n, radius)."""
        return self.vectors().groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))

    def _places(self, limit: int, probes: int | None):
        """Maps queries (query_id, embedding, threshold) to rows with a cell to be read: the nearest until they hold limit vectors (or probes), or with a threshold those within it that are not among these."""
        found = {r.cell: (r.n, r.radius) for r in self.sizes().collect()}  # as many as there are cells
        known = {d: (numbers, c, np.array([found.get(int(x), (0, 0.0))[0] for x in numbers]), np.array([found.get(int(x), (0, 0.0))[1] for x in numbers])) for d, (numbers, c) in self.centroids.items()}
        sent, odd = self.spark.sparkContext.broadcast(known), UNKNOWN in found

        def run(batches):
            for b in batches:
                at, cells = [], []
                for k, (v, threshold) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    if odd and threshold is None:
                        at.append(k)
                        cells.append(UNKNOWN)
                    if len(v) not in sent.value:
                        continue
                    numbers, centroids, n, radius = sent.value[len(v)]
                    d = distances(np.array([v], dtype=np.float64), centroids)[0]
                    order = np.argsort(d, kind="stable")
                    order = order[n[order] > 0]
                    first = probes or 1 + int(np.searchsorted(np.cumsum(n[order]), limit))
                    if threshold is None:
                        kept = order[:first]
                    else:
                        kept = order[first:]
                        least = np.maximum(0.0, d[kept] - radius[kept])
                        kept = kept[least * least <= threshold + MARGIN + 1e-9 * d[kept] ** 2]
                    at += [k] * len(kept)
                    cells += numbers[kept].tolist()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cells, pa.int32())], ["query_id", "embedding", "cell"])

        return run

    def _searched(self, places: DataFrame, n_queries: int, limit: int) -> DataFrame:
        """(query_id, id, distance) of the limit best of each query in each part of the cells it is to be searched in."""
        blocks = max(1, -(-n_queries // QUERIES))
        left = places.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        parts = self.sizes().select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        wanted = left.select(F.col("cell").alias("to"), F.col("block").alias("by")).distinct()
        right = self.vectors().select("id", F.col("embedding").alias("vector"), "cell").join(F.broadcast(parts), "cell").join(wanted, F.col("cell") == F.col("to"))
        right = right.select("id", "vector", F.col("to").alias("cell"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("by").alias("block"))
        left = left.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            out = [{"query_id": [], "id": [], "distance": []}]
            if len(q) and len(c):  # a side without rows has no columns
                lengths = c["vector"].map(len).astype("int64")
                for d, part in q.groupby(q["embedding"].map(len).astype("int64")):
                    own = c[(lengths == d).to_numpy()]
                    best = Nearest(part["query_id"].tolist(), np.stack(part["embedding"].to_numpy()).astype(np.float64), limit)
                    for at in range(0, len(own), 1024):
                        some = own.iloc[at : at + 1024]
                        best.add(some["id"].tolist(), np.stack(some["vector"].to_numpy()).astype(np.float64))
                    out.append(best.rows())
            return pd.DataFrame({k: [x for o in out for x in o[k]] for k in out[0]})

        schema = f"query_id {dict(places.dtypes)['query_id']}, id {dict(self.vectors().dtypes)['id']}, distance double"
        keys = ["cell", "part", "block"]
        return left.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "id", "vector").groupBy(*keys)).applyInPandas(run, schema)

    def _rounds(self, queries: DataFrame, limit: int, probes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries with thresholds, places of the first round, places of the second)."""
        kind = dict(queries.dtypes)["query_id"]
        schema = f"query_id {kind}, embedding array<double>, cell int"
        asked = queries.where("embedding is not null and query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        run = self._places(limit, probes)
        first = bounded(asked).withColumn("threshold", F.lit(None).cast("double")).mapInArrow(run, schema)
        if probes:
            return asked, first, first.where("false")
        best = self._ranked(self._searched(first, asked.count(), limit), limit)
        reached = best.groupBy("query_id").agg(F.max(F.when(F.col("rank") == limit, F.col("distance"))).alias("threshold"))
        second = asked.join(reached, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf")))).mapInArrow(run, schema)
        return asked, first, second

    @staticmethod
    def _ranked(found: DataFrame, limit: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", DECIMALS), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= limit)

    def search(self, queries: DataFrame, limit: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, score) for each of queries (query_id, embedding): all of the best, or those in the nearest ``probes`` cells."""
        if not self.parts:
            raise ValueError("nothing is stored")
        asked, first, second = self._rounds(queries, limit, probes)
        found = self._searched(first.unionByName(second), asked.count(), limit)
        return self._ranked(found, limit).select("query_id", "rank", "id", F.round(V.similarity(F.col("distance")), DECIMALS).alias("score"))

    def read_share(self, queries: DataFrame, limit: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, cells, vectors, share): how many cells and vectors a search of each query reads, and the share of all vectors."""
        _, first, second = self._rounds(queries, limit, probes)
        sizes = self.sizes()
        total = sizes.agg(F.sum("n").alias("total"))
        out = first.unionByName(second).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"))
        return out.join(F.broadcast(total)).select("query_id", "cells", "vectors", (F.col("vectors") / F.col("total")).alias("share"))  # total is one row


def _fine(vectors: DataFrame, id_column: str) -> DataFrame:
    """(id, embedding), ids unique."""
    rows = vectors.where(F.col("embedding").isNotNull() & F.col(id_column).isNotNull())
    return rows.groupBy(F.col(id_column).alias("id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))


def _assign(sent):
    def run(batches):
        for b in batches:
            values = b.column(1).to_pylist()
            cell, away = np.full(len(values), UNKNOWN, dtype=np.int32), np.zeros(len(values))
            lengths = np.array([len(v) for v in values], dtype=np.int64)
            for d, (numbers, centroids) in sent.value.items():
                own = np.flatnonzero(lengths == d)
                for at in range(0, len(own), 1024):
                    part = own[at : at + 1024]
                    far = distances(np.array([values[i] for i in part], dtype=np.float64), centroids)
                    cell[part] = numbers[far.argmin(axis=1)]
                    away[part] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(away)], ["id", "embedding", "cell", "away"])

    return run
