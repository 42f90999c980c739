"""Exact top-k search by inner product over integer vectors.

Vectors are cut into stripes by falling length. Each query is first searched in the stripe of the longest vectors,
which gives a score that its k-th best reaches at least. A query's threshold divided by its own length is the least length a
vector needs (Cauchy-Schwarz); queries are cut into blocks by that quotient, and a block is sent to those stripes only whose longest
vector has it, a stripe only to the blocks that need it.

Within a task the stripe's vectors, rotated by the right singular
vectors of a sample so that the first coordinates carry most of a product, go by in order
of falling length. A query is done when its length times the next vector's cannot reach its
threshold or k-th score; otherwise the product of the first coordinates plus the
lengths of the two rests bounds the score, and only vectors whose bound reaches it are
scored in full, in integers. The bounds carry a margin for rounding, so that no vector is
lost. Best rows of each stripe are merged, ties to the smaller id.

The rotation is fitted on the ``SAMPLE`` vectors of smallest id hash; any orthogonal one is
right, it only prunes less. Stripes and blocks have so many rows as make ``STRIPE`` and ``QUERIES`` bytes at the largest dimension in the sample. The driver
holds a length and a count for each stripe and each block; the ranges that a row goes to are the first so many, written as a count.

Vectors that are null, or hold null or non-finite components, or have a null id take no
part. Of rows with one id the smallest vector counts. A product is defined between vectors
of one dimension only. Scores beyond 64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

SAMPLE = 2048
STRIPE = 16 << 20  # bytes of the vectors of a stripe
LEAST = 2048  # vectors in a stripe of small tables, where as many stripes as TASKS are made of so many
TASKS = 16
QUERIES = 32 << 20  # bytes of the queries of a block
PART = 2048  # queries, and
CHUNK = 1024  # vectors multiplied at once
BROADCAST_ROWS = 1_000_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integers(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<double>) of vectors that take part, each component floor(scale * x)."""
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = df.where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    return one.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each dimension, its columns by falling singular value."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"]
    out = {}
    for d in {len(v) for v in rows if len(v)}:
        x = np.array([v for v in rows if len(v) == d], dtype=np.float64)
        peak = np.abs(x).max() or 1.0
        _, axes = np.linalg.eigh((x / peak).T @ (x / peak))
        out[d] = axes[:, ::-1].copy()
    return out


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, axes: np.ndarray | None, head: int | None = None, least: np.ndarray | None = None):
    """The k best candidates of each query that score ``least`` or more: (query row, candidate id, score), in no order. All vectors of one dimension."""
    d = q.shape[1]
    axes = np.eye(d) if axes is None else axes
    head = head or max(1, min(d, (d + 3) // 4))
    qr, cr = q @ axes, c @ axes
    ql, cl = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    order = np.argsort(-cl, kind="stable")
    cid, c, cr, cl = cid[order], c[order], cr[order], cl[order]
    qrest, crest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(cr[:, head:], axis=1)
    exact = bool(len(cl) and len(ql)) and float(cl[0]) * float(ql.max()) < 2.0**52
    small = bool(len(cl) and len(ql)) and float(cl[0]) * float(ql.max()) < 2.0**62 and max(np.abs(c).max(initial=0), np.abs(q).max(initial=0)) < 2.0**62
    best_s = np.full((len(q), k), LOW, dtype=np.int64)
    best_i = np.full((len(q), k), HIGH, dtype=np.int64)
    filled = np.zeros(len(q), dtype=np.int64)
    live = np.arange(len(q))
    least = np.full(len(q), -np.inf) if least is None else least
    slack = 1e-9 * (float(cl[0]) if len(cl) else 0.0) * ql + 1e-6

    def floors(rows: np.ndarray) -> np.ndarray:
        return np.maximum(least[rows], np.where(filled[rows] >= k, best_s[rows, k - 1].astype(np.float64), -np.inf))

    def full(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if exact:
            return np.einsum("ij,ij->i", q[rows], c[cols]).astype(np.int64)
        if small:
            return np.einsum("ij,ij->i", q[rows].astype(np.int64), c[cols].astype(np.int64))
        return np.array([max(LOW, min(HIGH, sum(int(x) * int(y) for x, y in zip(q[i], c[j])))) for i, j in zip(rows, cols)], dtype=np.int64)

    for at in range(0, len(c), CHUNK):
        part = slice(at, at + CHUNK)
        live = live[ql[live] * cl[at] + slack[live] >= floors(live)]
        if not len(live):
            break
        floor = floors(live)
        bound = qr[live, :head] @ cr[part, :head].T
        bound += qrest[live][:, None] * crest[part][None, :]
        hit = bound + slack[live][:, None] >= floor[:, None]
        hit &= qid[live][:, None] != cid[part][None, :]
        if exact and hit.mean() > 0.05:  # so many are left that whole products are cheaper together
            scores = np.where(hit, q[live] @ c[part].T, -np.inf)
            width = scores.shape[1]
            if width > 4 * k:  # of these products no more than the k best and their ties can stay
                cut = np.partition(scores, width - k, axis=1)[:, width - k]
                hit &= scores >= np.maximum(cut, floor)[:, None]
            rows, cols = np.nonzero(hit)
            got = scores[rows, cols].astype(np.int64)
        else:
            rows, cols = np.nonzero(hit)
            got = full(live[rows], cols + at)
        if not len(rows):
            continue
        r = np.concatenate([live[rows], np.repeat(live, k)])
        s = np.concatenate([got, best_s[live].ravel()])
        i = np.concatenate([cid[part][cols], best_i[live].ravel()])
        real = np.concatenate([np.ones(len(rows), bool), (np.arange(k)[None, :] < filled[live][:, None]).ravel()])
        r, s, i = r[real], s[real], i[real]
        o = np.lexsort((i, ~s, r))  # ~s falls as s rises, without overflow
        r, s, i = r[o], s[o], i[o]
        start = np.concatenate([[0], np.nonzero(np.diff(r))[0] + 1])
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate([start, [len(r)]])))
        keep = rank < k
        r, s, i, rank = r[keep], s[keep], i[keep], rank[keep]
        best_s[r, rank], best_i[r, rank] = s, i
        np.maximum.at(filled, r, rank + 1)
    rows, ranks = np.nonzero(np.arange(k)[None, :] < filled[:, None])
    return rows, best_i[rows, ranks], best_s[rows, ranks]


def cut(df: DataFrame, n: int, name: str, *order) -> DataFrame:
    """df, written, with its column ``name``: one of at most n ranges in that order, ties spread by id."""
    return saved(df.repartitionByRange(max(1, n), *order, F.xxhash64("vec_id")).withColumn(name, F.spark_partition_id()), name)


def searched(left: DataFrame, right: DataFrame, keys: list[str], k: int, axes: dict[int, np.ndarray]) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query (vec_id, v, least) among the vectors (vec_id, v) under the same keys."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(q) or not len(c):  # a side without rows has no columns
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        dims, of = q["v"].map(len), c["v"].map(len)
        for d in sorted((set(dims) & set(of)) - {0}):
            qd, cd = q[dims == d], c[of == d]
            vectors, ids = np.stack(cd["v"].to_numpy()), cd["vec_id"].to_numpy()
            for at in range(0, len(qd), PART):
                part = qd.iloc[at : at + PART]
                own = part["vec_id"].to_numpy()
                rows, found, scores = search(own, np.stack(part["v"].to_numpy()), ids, vectors, k, axes.get(d), least=part["least"].fillna(-np.inf).to_numpy())
                out.append(pd.DataFrame({"query_id": own[rows], "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    left, right = left.select(*keys, "vec_id", "v", "least"), right.select(*keys, "vec_id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def needed(stripes: list[tuple[int, float]], blocks: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first blocks each stripe goes to, and of the first stripes each block: stripes (number, greatest length) have less and less, blocks (number, least length that they need) need more and more."""
    longs = np.array([x for _, x in stripes], dtype=np.float64) * (1 + 1e-9) + 1e-6
    least = np.array([x for _, x in blocks], dtype=np.float64)
    return np.searchsorted(least, longs, "right"), len(longs) - np.searchsorted(longs[::-1], least, "left")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query; both tables (vec_id, v), ids unique."""
    spark = vectors.sparkSession
    axes, n, m = rotation(vectors), vectors.count(), queries.count()
    rows = lambda size: max(1, size // (8 * max(axes, default=1)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stripes = cut(vectors.select("vec_id", "v", length.alias("length")), max(-(-n // rows(STRIPE)), min(TASKS, -(-n // LEAST))), "stripe", F.desc("length"))
    longest = sorted((r.stripe, r.length) for r in stripes.groupBy("stripe").agg(F.max("length").alias("length")).collect())  # a row a stripe
    top = longest[0][0] if longest else 0
    n_blocks = max(1, -(-m // rows(QUERIES)))
    asked = queries.select("vec_id", "v", length.alias("length"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(None).cast("double").alias("least"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    first = saved(searched(asked, stripes.where(F.col("stripe") == top).select("vec_id", "v", each), ["block"], k, axes), "first")

    # what a query's k-th best reaches, and the length that takes
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")
    needs = F.coalesce(F.when(F.col("length") > 0, F.col("least") / F.col("length")), F.lit(float("-inf")))
    blocks = cut(asked.drop("block", "least").join(reached, "vec_id", "left").withColumn("needs", needs), n_blocks, "block", "needs")
    ends = sorted((r.block, r.needs) for r in blocks.groupBy("block").agg(F.min("needs").alias("needs")).collect())  # a row a block
    rest = [(s, long) for s, long in longest if s != top]
    for_stripe, for_block = needed(rest, ends)

    def spread(df, own, other, counts):
        """Each row under its range's number among those that are there, a copy for each of the first so many of the other's."""
        table = spark.createDataFrame([(i, k, int(c)) for k, (i, c) in enumerate(counts) if c], f"{own} int, _place int, _count int")
        table = F.broadcast(table) if len(counts) <= BROADCAST_ROWS else table
        return df.join(table, own).withColumn(own, F.col("_place")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))

    left = spread(blocks, "block", "stripe", [(b, c) for (b, _), c in zip(ends, for_block)])
    right = spread(stripes, "stripe", "block", [(s, c) for (s, _), c in zip(rest, for_stripe)])
    found = first.unionByName(searched(left, right, ["block", "stripe"], k, axes))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark, sf_dir):
    vectors = saved(integers(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
