"""Postings in blocks with bounds of their impact, and top-k searches that leave out blocks which cannot matter.

A shard is a run of at most ``SHARD`` chunks with about ``TERMS`` terms that one task reads, in the order of their length and id; a chunk is known by
its number in its shard. A block is up to ``BLOCK`` postings (of rare terms fewer) of one term in one shard, in that order. So blocks of different terms that hold one
chunk overlap in their ranges. A block's row has its range, its largest tf and
the shortest length for each tf of 1, 2, 3 and more, from which the largest BM25 weight follows for whatever statistics hold at
the time of the query; the postings are arrays of numbers beside them, which a scan for bounds does not read. Short chunks weigh most, so bounds fall along the order.
Ids stand once for each chunk, in rows without a term; hits are counted and ranked by numbers and get their ids last.

Postings are made where the chunks are read: no row for a posting is ever shuffled or written.

A search looks at bounds alone first. For each shard the ranges are cut where a block begins or ends; the sum of the terms' bounds in a piece
limits every chunk in it. The blocks of the best pieces of each shard are scored, which gives a threshold: the limit-th best score found. Then only
blocks with a piece that reaches the threshold (with all terms, if all are asked for) are scored. The rows are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textindex
from .batches import bounded

BLOCK = 128
#: Blocks that the postings of a term in a shard are cut into at least, so that those of rare terms have narrow ranges.
LEAST = 16
#: Chunks, and about how many terms with repeats, in a shard.
SHARD = 65_536
TERMS = 1 << 21
#: Blocks of each term that a shard contributes to the threshold.
FIRST = 2
#: Scores are rounded, so bounds this far below the threshold are still looked at.
MARGIN = 1e-5
LEVELS = 4
#: Chunks whose ids one row has.
NAMED = 128
#: Rows that leave a task at once.
SENT = 16_384
SCHEMA = (
    "term string, shard long, block int, n int, first int, last int, top_tf int, shortest array<int>, number array<int>, tf array<int>, length array<int>, "
    "positions array<array<int>>, chunk_id array<string>, document_id array<string>"
)
_INTS = pa.list_(pa.int32())
ARROW = pa.schema(
    [("term", pa.string()), ("shard", pa.int64()), *[(c, pa.int32()) for c in ("block", "n", "first", "last", "top_tf")], *[(c, _INTS) for c in ("shortest", "number", "tf", "length")]]
    + [("positions", pa.list_(_INTS)), *[(c, pa.list_(pa.string())) for c in ("chunk_id", "document_id")]]
)


def _lists(offsets: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _rows(columns: dict, size: int) -> pa.Table:
    return pa.table([columns.get(f.name, pa.nulls(size, f.type)) for f in ARROW], schema=ARROW)


def shard_rows(shard: int, chunk_ids: pa.Array, document_ids: pa.Array, terms: pa.Array, block: int, least: int) -> Iterator[pa.Table]:
    """The rows of one shard: the ids of its chunks, which are in order, and the blocks of its terms."""
    n = len(chunk_ids)
    offsets = np.minimum(np.arange(-(-n // NAMED) + 1) * NAMED, n)
    k = len(offsets) - 1
    yield _rows({"shard": pa.array(np.full(k, shard)), "block": _ints(np.arange(k)), "n": _ints(np.diff(offsets)), "chunk_id": _lists(offsets, chunk_ids), "document_id": _lists(offsets, document_ids)}, k)
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not lengths.sum():
        return
    coded = terms.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    key = place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths)
    at = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    by = np.argsort(key, kind="stable")  # by term, chunk, and position
    key, at = key[by], at[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    term, number = np.divmod(key[start], n)
    tf = np.diff(np.append(start, len(key)))
    df = np.bincount(term, minlength=len(order))
    rank = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    size = np.minimum(block, -(-df // least))[term]
    begin = np.flatnonzero(rank % size == 0)
    end = np.append(begin[1:], len(term))
    own = lengths[number]
    none = np.iinfo(np.int32).max
    shortest = np.stack([np.minimum.reduceat(np.where(tf == j if j < LEVELS else tf >= j, own, none), begin) for j in range(1, LEVELS + 1)], axis=1)
    dictionary = coded.dictionary.take(pa.array(order))
    top = np.maximum.reduceat(tf, begin)
    for a in range(0, len(begin), SENT):
        z = min(a + SENT, len(begin))
        p, q = begin[a], end[z - 1]  # postings
        cut = np.append(begin[a:z], q) - p
        some = shortest[a:z].ravel()
        positions = _lists(np.append(start[p:q], start[q] if q < len(start) else len(key)) - start[p], _ints(at[start[p] : start[q] if q < len(start) else len(key)]))
        yield _rows(
            {
                "term": dictionary.take(pa.array(term[begin[a:z]])), "shard": pa.array(np.full(z - a, shard)), "block": _ints((rank // size)[begin[a:z]]), "n": _ints(end[a:z] - begin[a:z]),
                "first": _ints(number[begin[a:z]]), "last": _ints(number[end[a:z] - 1]), "top_tf": _ints(top[a:z]),
                "shortest": _lists(np.arange(z - a + 1) * LEVELS, pa.array(some.astype(np.int32), mask=some == none)),
                "number": _lists(cut, _ints(number[p:q])), "tf": _lists(cut, _ints(tf[p:q])), "length": _lists(cut, _ints(own[p:q])), "positions": _lists(cut, positions),
            },
            z - a,
        )


def built(chunks: DataFrame) -> DataFrame:
    """Blocks of chunks (chunk_id, document_id, terms) as SCHEMA has them; shards are cut from what each task reads, nothing is shuffled."""
    most, about, block, least = SHARD, TERMS, BLOCK, LEAST

    def run(batches):
        first, held, size, count, shards = TaskContext.get().partitionId() << 32, [], 0, 0, 0

        def flushed():
            columns = [pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in range(3)]
            for table in shard_rows(first + shards, *columns, block, least):
                yield from table.to_batches()

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            done = 0
            while done < b.num_rows:
                before = sizes[done - 1] if done else 0
                more = min(most - count, max(1, int(np.searchsorted(sizes, before + about - size, side="right")) - done), b.num_rows - done)
                held.append(b.slice(done, more))
                size, count, done = size + int(sizes[done + more - 1] - before), count + more, done + more
                if count >= most or size >= about:
                    yield from flushed()
                    held, size, count, shards = [], 0, 0, shards + 1
        if held:
            yield from flushed()

    rows = chunks.select("chunk_id", "document_id", "terms").sortWithinPartitions(F.coalesce(F.size("terms"), F.lit(0)), "chunk_id")
    return bounded(rows).mapInArrow(run, SCHEMA)


def blocked(postings: DataFrame, shards: int) -> DataFrame:
    """Blocks of postings (term, chunk_id, document_id, tf, length, positions), from the chunks that they make up, in so many tasks."""
    each = postings.select("chunk_id", "document_id", "term", F.explode("positions").alias("at"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    return built(each.groupBy("chunk_id", "document_id").agg(terms.alias("terms")).repartition(shards, "chunk_id"))


def opened(blocks: DataFrame, positions: bool = False) -> DataFrame:
    """The postings in blocks, one a row; other columns of the blocks stay."""
    names = ["number", "tf", "length", *["positions"] * positions]
    more = [c for c in blocks.columns if c not in ("n", "first", "last", "top_tf", "shortest", "number", "tf", "length", "positions", "chunk_id", "document_id")]
    return blocks.where("term is not null").select(*more, F.explode(F.arrays_zip(*names)).alias("p")).select(*more, *[F.col(f"p.{c}").alias(c) for c in names])


def named(blocks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, segment, shard, number) of the chunks in blocks."""
    rows = blocks.where("term is null").select("segment", "shard", "block", F.posexplode(F.arrays_zip("chunk_id", "document_id")).alias("k", "c"))
    return rows.select("c.chunk_id", "c.document_id", "segment", "shard", (F.col("block") * NAMED + F.col("k")).alias("number"))


def bound(df: Column, n: Column, mean: Column) -> Column:
    """The largest BM25 weight in a block."""
    tf = [F.lit(k) for k in range(1, LEVELS)] + [F.col("top_tf")]
    each = [F.coalesce(textindex.bm25(tf[k], F.col("shortest")[k], df, n, mean), F.lit(0.0)) for k in range(LEVELS)]
    return F.greatest(*each)


def _pieces(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first piece of each block, last piece, sum of bounds by piece, number of terms by piece) of one query's blocks in one shard."""
    first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
    ends = np.unique(np.concatenate([first, last]))
    begin, end = 2 * np.searchsorted(ends, first), 2 * np.searchsorted(ends, last)  # even: a place; odd: between two
    step = lambda amount: np.cumsum(np.bincount(begin, amount, 2 * len(ends)) - np.bincount(end + 1, amount, 2 * len(ends) + 1)[: 2 * len(ends)])
    return begin, end, step(rows["bound"].to_numpy(dtype=float)), np.rint(step(np.ones(len(rows)))).astype(int)


KEPT = "query_id long, segment string, shard long, term string, block int, n int"


def kept_of_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one query and shard to be scored: with a threshold those that reach it, without one those of the best pieces."""
    begin, end, total, terms = _pieces(rows)
    wanted, threshold = int(rows["wanted"].iloc[0]), rows["threshold"].iloc[0]
    able = terms >= wanted
    if not pd.isna(threshold):
        able &= total >= threshold - MARGIN
    elif able.any():
        kinds, limit, n = max(1, int(terms.max())), int(rows["limit"].iloc[0]), rows["n"].to_numpy()
        best = np.flatnonzero(able)[np.argsort(-total[able], kind="stable")]
        chosen, touched = np.zeros(len(able), dtype=bool), np.zeros(len(rows), dtype=bool)
        for piece in best[: 64 * kinds + 8 * limit]:
            chosen[piece] = True
            touched |= (begin <= piece) & (piece <= end)
            if touched.sum() >= FIRST * kinds and n[touched].sum() >= 2 * limit * kinds:
                break
        able = chosen
    reach = np.concatenate([[0], np.cumsum(able)])
    return rows.loc[reach[end + 1] > reach[begin], ["query_id", "segment", "shard", "term", "block", "n"]]


#: What a chunk is known by.
HIT = ["segment", "shard", "number"]


class BlockSearch:
    """Searches for batches of terms over blocks (segment, term, shard, block, n, first, last, top_tf, shortest, and the arrays); names has the ids of their chunks.

    ``terms`` is (query_id, term, boost, df, wanted): df is a term's frequency in the index, wanted how many different terms a hit
    must have. ``live`` takes postings with their segment, shard and number to those that are not deleted. ``inside`` (chunk_id) restricts hits
    before anything is ranked; statistics stay those of the index.
    """

    def __init__(self, blocks: DataFrame, names: DataFrame, terms: DataFrame, numbers: tuple[int, float], limit: int, live=lambda rows: rows, inside: DataFrame | None = None, min_score: float = 0.0, few: bool = False):
        self.blocks, self.names, self.terms, self.limit, self.live, self.min_score = blocks, names, F.broadcast(terms) if few else terms, limit, live, min_score
        self.inside = None if inside is None else names.join(inside, "chunk_id", "left_semi").select(*HIT)
        self.n, self.mean = F.lit(numbers[0]), F.lit(numbers[1] or 1.0)

    def bounds(self, thresholds: DataFrame | None = None) -> DataFrame:
        meta = self.blocks.select("segment", "term", "shard", "block", "n", "first", "last", "top_tf", "shortest").join(self.terms, "term")
        out = meta.select("query_id", "segment", "shard", "term", "block", "n", "first", "last", "wanted", F.lit(self.limit).alias("limit"), (bound(F.col("df"), self.n, self.mean) * F.col("boost")).alias("bound"))
        if thresholds is None:
            return out.withColumn("threshold", F.lit(None).cast("double"))
        return out.join(thresholds, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))

    def chosen(self, thresholds: DataFrame | None = None) -> DataFrame:
        return self.bounds(thresholds).groupBy("query_id", "segment", "shard").applyInPandas(kept_of_shard, KEPT)

    def scored(self, chosen: DataFrame) -> DataFrame:
        """(query_id, segment, shard, number, score) of the hits in the blocks chosen."""
        rows = self.blocks.select("segment", "term", "shard", "block", "number", "tf", "length").join(chosen.drop("n"), ["segment", "term", "shard", "block"])
        rows = self.live(opened(rows))
        if self.inside is not None:
            rows = rows.join(self.inside, HIT, "left_semi")
        rows = rows.join(self.terms, ["query_id", "term"])
        weight = textindex.bm25(F.col("tf"), F.col("length"), F.col("df"), self.n, self.mean) * F.col("boost")
        out = rows.groupBy("query_id", *HIT, "wanted").agg(F.round(F.sum(weight), textindex.DECIMALS).alias("score"), F.count("*").alias("terms"))
        return out.where((F.col("terms") >= F.col("wanted")) & (F.col("score") >= self.min_score)).select("query_id", *HIT, "score")

    def ranked(self, hits: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kept = hits.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= self.limit).drop("rank")  # with all that tie with the last
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return kept.join(self.names, HIT).withColumn("rank", rank).where(F.col("rank") <= self.limit).select("query_id", "rank", "chunk_id", "document_id", "score")

    def thresholds(self) -> DataFrame:
        """(query_id, threshold): the limit-th best score of the first round, or null."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        best = self.scored(self.chosen()).withColumn("rank", rank).where(F.col("rank") <= self.limit)
        return best.groupBy("query_id").agg(F.min(F.when(F.col("rank") == self.limit, F.col("score"))).alias("threshold"))

    def top(self) -> DataFrame:
        """(query_id, rank, chunk_id, document_id, score), best first in each query."""
        return self.ranked(self.scored(self.final()))

    def final(self) -> DataFrame:
        """The blocks of the second round; a query without a hit in the first reads all."""
        return self.chosen(self.thresholds()) if self.limit else self.chosen()
