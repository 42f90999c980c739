"""A text index that grows by segments.

Each change writes one immutable segment: the blocks of the chunks it adds (sorted by term in each file), their terms by chunk, the ids of chunks that are gone from
earlier segments, with the segment they are gone from and their number there, and what the change adds to or takes from the document frequency of each term. Nothing older is
rewritten, so a change of k chunks writes rows for those k. A chunk is live if no segment says that it is gone from its own; a chunk that is added again
replaces itself. Frequencies, the number of chunks and their length are sums over segments, so scores are those of an index built anew.

The youngest segments are merged once ``FANOUT`` of about one size are among them, so there are few of them and a chunk is rewritten as
often as the logarithm of the index. A merge leaves out what is gone and keeps the sums.

The list of segments is a small versioned table. Of two writers with the same list one succeeds; the other makes its change again on the new list. Folders
that no kept list names are deleted after a later change. Deleted ids are broadcast up to ``BROADCAST`` of them (their number is in the list), beyond
that they are joined by shuffle. Hot terms are split by shards. An empty index finds nothing.
"""

from __future__ import annotations

import uuid
from collections import namedtuple
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import blocks, textindex

FANOUT = 4
#: Rows of a segment of the lowest tier.
BASE = 1000
BROADCAST = 500_000
LIST = "segment string, generation long, chunks long, gone long, postings long, n long, length long, analyzer string"
BLOCKS = f"{blocks.SCHEMA}, segment string"
Row = namedtuple("Row", [x.split()[0] for x in LIST.split(", ")])
FORWARD, GONE, FREQUENCIES = "chunk_id string, document_id string, terms array<string>, segment string", "chunk_id string, in_segment string, shard long, number int, segment string", "term string, df long, segment string"


@dataclass
class Segments:
    """The segments in a folder, as their list was when this was opened."""

    spark: SparkSession
    root: str
    rows: list
    number: int | None  # of the list
    analyzer: str = "standard"

    @staticmethod
    def open(spark: SparkSession, root: str, analyzer: str = "standard") -> Segments:
        number, listed = tables.numbered(spark, f"{root}/list")
        rows = sorted((Row(*r) for r in listed.select(*Row._fields).collect()), key=lambda r: r.generation) if listed is not None else []  # a row for each segment: the logarithm of the index
        return Segments(spark, root, rows, number, rows[0].analyzer if rows else analyzer)

    # --- reading -------------------------------------------------------------------------------

    def _read(self, name: str, schema: str, names: list[str] | None = None) -> DataFrame:
        there = [r.segment for r in self.rows if name != "gone" or r.gone] if names is None else names
        if not there:
            return self.spark.createDataFrame([], schema)
        at = f"{self.root}/{name}"
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/segment={s}" for s in there])

    @property
    def n(self) -> int:
        return sum(r.n for r in self.rows)

    @property
    def mean_length(self) -> float:
        return sum(r.length for r in self.rows) / self.n if self.n else 0.0

    def live(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Of rows (segment, and shard and number, or else chunk_id, ...) those of chunks that no segment (of those named) says are gone."""
        deleting = [r for r in self.rows if r.gone and (names is None or r.segment in names)]
        if not deleting:
            return rows
        keys = ["shard", "number"] if "number" in rows.columns else ["chunk_id"]
        gone = self._read("gone", GONE, [r.segment for r in deleting]).select(*keys, F.col("in_segment").alias("segment"))
        if sum(r.gone for r in deleting) <= BROADCAST:
            gone = F.broadcast(gone)
        return rows.join(gone, [*keys, "segment"], "left_anti")

    def chunks(self) -> DataFrame:
        """(chunk_id, document_id, segment, shard, number) of the live chunks."""
        return self.live(self.names())

    def names(self) -> DataFrame:
        """The same of all chunks."""
        return blocks.named(self.blocks())

    def frequencies(self) -> DataFrame:
        """(term, df) of the live chunks."""
        return self._read("frequencies", FREQUENCIES).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """The blocks of some terms, or all and the ids of chunks: of the files, which are sorted by term, only the pages of these."""
        out = self._read("blocks", BLOCKS, [r.segment for r in self.rows if r.chunks])
        return out if terms is None else out.where(F.col("term").isin(terms))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, chunk_id, document_id, tf, length, positions) of the live chunks."""
        rows = self.live(blocks.opened(self.blocks(terms), positions=True)).drop("block")
        return rows.join(self.names(), blocks.HIT).drop(*blocks.HIT)

    def text_index(self) -> textindex.TextIndex:
        """For the whole query grammar; searches of plain terms with a limit go by blocks."""
        statistics = self.spark.createDataFrame([(self.n, self.mean_length, self.analyzer)], "n long, mean_length double, analyzer string")
        return textindex.TextIndex(self.postings(), statistics, self.analyzer, numbers=(self.n, self.mean_length or 1.0), segments=self)

    def search(self, boosts: dict[str, float], every: bool, limit: int, inside: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
        """(chunk_id, document_id, score) of the best chunks that hold the terms (any of them, if not every)."""
        return self.by_blocks(boosts, every, limit, inside, min_score).top().select("chunk_id", "document_id", "score")

    def by_blocks(self, boosts: dict[str, float], every: bool, limit: int, inside: DataFrame | None = None, min_score: float = 0.0) -> blocks.BlockSearch:
        found = {r.term: r.df for r in self.frequencies().where(F.col("term").isin(list(boosts))).collect()}  # at most the query's terms
        rows = [(0, t, float(b), found[t], len(boosts) if every else 1) for t, b in boosts.items() if t in found]
        if every and len(found) < len(boosts):
            rows = []
        terms = self.spark.createDataFrame(rows, "query_id long, term string, boost double, df long, wanted int")
        return blocks.BlockSearch(self.blocks(sorted(found)), self.names(), terms, (self.n, self.mean_length), limit, self.live, inside, min_score, few=True)

    def search_batch(self, queries: DataFrame, limit: int, every: bool = True) -> blocks.BlockSearch:
        """A search of each of queries (query_id, text) for all its different tokens, or any."""
        asked = queries.select("query_id", F.explode(F.array_distinct(textindex.analysed(F.col("text"), self.analyzer))).alias("term"))
        wanted = asked.groupBy("query_id").agg((F.count("*") if every else F.lit(1)).cast("int").alias("wanted"))
        terms = asked.join(wanted, "query_id").join(self.frequencies(), "term").withColumn("boost", F.lit(1.0))
        return blocks.BlockSearch(self.blocks(), self.names(), terms.select("query_id", "term", "boost", "df", "wanted"), (self.n, self.mean_length), limit, self.live)

    # --- writing -------------------------------------------------------------------------------

    def changed(self, added: DataFrame | None = None, documents: DataFrame | None = None, chunks: DataFrame | None = None) -> Segments:
        """The index after one change: added (chunk_id, document_id, terms) come, those of documents (document_id) and chunks (chunk_id) go.

        A chunk that is there and added again is replaced. Of rows added with one id one counts; null ids are left out.
        """
        out = self
        while True:
            try:
                out = out._changed(added, documents, chunks)
                break
            except tables.Conflict:  # another writer's list is newer: the change is made again on that
                out = Segments.open(self.spark, self.root, self.analyzer)
        try:
            return out._merged()
        except tables.Conflict:  # whoever came in between will merge
            return Segments.open(self.spark, self.root, self.analyzer)

    def _name(self, generation: int) -> str:
        return f"g{generation:012d}-{uuid.uuid4().hex[:12]}"

    def _put(self, df: DataFrame, name: str, segment: str) -> None:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/{name}/segment={segment}")

    def _back(self, name: str, schema: str, segment: str) -> DataFrame:
        return self._read(name, schema, [segment])

    def _changed(self, added: DataFrame | None, documents: DataFrame | None, chunks: DataFrame | None) -> Segments:
        generation = max((r.generation for r in self.rows), default=-1) + 1
        segment = self._name(generation)
        new = added.where("chunk_id is not null").select("chunk_id", "document_id", "terms").dropDuplicates(["chunk_id"]) if added is not None else self.spark.createDataFrame([], FORWARD).drop("segment")
        self._put(new, "forward", segment)
        forward = self._back("forward", FORWARD, segment)
        gone = None
        if self.rows:
            there = self.chunks()
            parts = [there.join(forward.select("chunk_id"), "chunk_id", "left_semi")]
            if documents is not None:
                parts.append(there.join(documents.select("document_id").distinct(), "document_id", "left_semi"))
            if chunks is not None:
                parts.append(there.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"))
            gone = parts[0]
            for p in parts[1:]:
                gone = gone.unionByName(p)
            # where they are is written with them: their terms are read from those segments only
            self._put(gone.distinct().select("chunk_id", F.col("segment").alias("in_segment"), "shard", "number"), "gone", segment)
            gone = self._back("gone", GONE, segment).drop("segment")
        return self._finish(segment, generation, forward, gone, self.rows)

    def _finish(self, segment: str, generation: int, forward: DataFrame, gone: DataFrame | None, before: list) -> Segments:
        terms = lambda rows: rows.select(F.explode(F.array_distinct("terms")).alias("term"))
        size = lambda rows: rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("length")).first()
        plus = size(forward)
        minus, lost = (0, 0), None
        if gone is not None:
            where = [r.in_segment for r in gone.select("in_segment").distinct().collect()]  # segments, so few
            if where:
                ids = gone.select("chunk_id", F.col("in_segment").alias("segment"))
                ids = F.broadcast(ids) if gone.count() <= BROADCAST else ids  # so that no terms are shuffled
                lost = self._read("forward", FORWARD, where).join(ids, ["chunk_id", "segment"], "left_semi")
                minus = size(lost)
        delta = terms(forward).groupBy("term").agg(F.count("*").alias("df"))
        if lost is not None:
            delta = delta.union(terms(lost).groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._put(delta.sort("term") if plus[0] + minus[0] > BASE else delta.coalesce(1).sortWithinPartitions("term"), "frequencies", segment)
        row = self._written(segment, generation, forward, plus[0], minus[0], plus[0] - minus[0], plus[1] - minus[1])
        return self._listed([*before, row], {r.segment for r in before})

    def _written(self, segment: str, generation: int, forward: DataFrame, chunks: int, gone: int, n: int, length: int):
        postings = 0
        if chunks:
            postings = forward.agg(F.coalesce(F.sum(F.size(F.array_distinct("terms"))), F.lit(0))).first()[0]
            self._put(blocks.built(forward), "blocks", segment)
        return Row(segment, generation, chunks, gone, postings, n, length, self.analyzer)

    def _listed(self, rows: list, expected: set[str]) -> Segments:
        """Publishes a list that follows from this one; Conflict if another came in between."""
        number = tables.publish(self.spark.createDataFrame([tuple(r) for r in rows], LIST).coalesce(1), f"{self.root}/list", base=self.number if self.number is not None else -1)
        out = Segments(self.spark, self.root, sorted(rows, key=lambda r: r.generation), number, self.analyzer)
        out._swept(expected)
        return out

    def _swept(self, before: set[str]) -> None:
        """Deletes folders that neither this list nor the one before names."""
        kept = before | {r.segment for r in self.rows}
        youngest = max((r.generation for r in self.rows), default=-1)
        for name in ("forward", "gone", "frequencies", "blocks"):
            for s in tables.children(self.spark, f"{self.root}/{name}"):
                segment = s.removeprefix("segment=")
                if segment != s and segment not in kept and int(segment[1:13]) < youngest:  # a younger one may be another writer's
                    tables.drop(self.spark, f"{self.root}/{name}/{s}")

    # --- merging -------------------------------------------------------------------------------

    @staticmethod
    def _tier(row) -> int:
        size, tier = (row.chunks + row.gone) // BASE, 0
        while size:
            size, tier = size // FANOUT, tier + 1
        return tier

    def due(self) -> list:
        """The youngest segments that are to be merged, or none."""
        for tier in sorted({self._tier(r) for r in self.rows}):
            run = []
            for r in reversed(self.rows):
                if self._tier(r) > tier:
                    break
                run.append(r)
            if sum(self._tier(r) == tier for r in run) >= FANOUT:
                return list(reversed(run))
        return []

    def _merged(self) -> Segments:
        out = self
        while run := out.due():
            out = out._merge(run)
        return out

    def _merge(self, run: list) -> Segments:
        names, generation = [r.segment for r in run], run[-1].generation
        segment = self._name(generation)
        oldest = run[0].segment == self.rows[0].segment
        self._put(self.live(self._read("forward", FORWARD, names), names).drop("segment"), "forward", segment)
        forward = self._back("forward", FORWARD, segment)
        gone = 0
        if not oldest:  # what older segments hold stays gone
            deleting = [r.segment for r in run if r.gone]
            if deleting:
                inside = self.spark.createDataFrame([(s,) for s in names], "in_segment string")
                left = self._read("gone", GONE, deleting).join(F.broadcast(inside), "in_segment", "left_anti")
                self._put(left.drop("segment").distinct(), "gone", segment)
                gone = self._back("gone", GONE, segment).count()
        delta = self._read("frequencies", FREQUENCIES, names).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._put(delta.sortWithinPartitions("term"), "frequencies", segment)
        row = self._written(segment, generation, forward, forward.count(), gone, sum(r.n for r in run), sum(r.length for r in run))
        rest = [r for r in self.rows if r.segment not in names]
        return self._listed([*rest, row], {r.segment for r in self.rows})
