"""Benchmark decontamination by canonical templates.

Words are case-folded and stripped of punctuation; numbers (with a unit written to
them or not), units after a number, and names (capitalised words inside a sentence)
become typed placeholders. Windows of five words with at least three literal ones are hashed,
with and without names replaced, and joined by hash to the windows of the benchmark.
Windows of a document and an item at one distance from each other should fill the
slots consistently: equal numbers and names of the item are equal in the document (different
ones may become equal). What most of the windows fill in for a value is its filling; a window
that has another is not counted. A document holds an item if at least 0.8
of the item's windows are found in it, so a question with its numbers and names
exchanged is found, and a text that only shares phrases is not.

Before the join, document windows that are in no benchmark window are left out by a sorted
array of the benchmark's hashes, if there are at most ``FILTER`` of them (32 MB); beyond
that all windows are joined. What remains is joined to the rarest windows of each item first: a document
that holds ``share`` of an item's windows holds one of its n - ceil(share * n) + 1 rarest, by the
number of their occurrences in the documents. Only the pairs so found are compared whole, so a window that is in many
items and documents makes no pairs by itself.

An item without such a window (mostly numbers, units and signs) has instead, in a channel of
its own, all windows of its words as they stand, signs and numbers included, so that verbatim
copies of it are found.

Items and texts shorter than five words are one window. Null texts are empty; rows with a null id are left out, of
documents as of items; rows with one id count together; other columns are ignored;
empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, drop, saved, table, without
from .words import NUMBER, PLAIN, PUNCTUATION, UNIT, Vocabulary, hashes_at, window_hashes

WINDOW = 5
LITERAL = 3
SHARE = 0.8
FILTER = 4_000_000
BROADCAST_ROWS = 1_000_000
MARK = {NUMBER: np.uint64(0x9D5F3A7C11E2B4D1), UNIT: np.uint64(0x5A8E6B2FC07D3911), "name": np.uint64(0x7C3B90E45D16A82F)}
SEPARATOR = "\x1f"
EXACT = 2  # the channel of words as they stand


class Canonical:
    """A text's words with their hashes, without and with names as placeholders."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        words = text.split()
        codes = every = vocabulary.codes(words)
        kind = vocabulary.kind[codes]
        kept = np.nonzero(kind >= 0)[0]
        codes, kind = codes[kept], kind[kept]
        self.words, self.kept = words, kept
        ends, title = vocabulary.ends[codes], vocabulary.title[codes]
        number = kind == NUMBER
        after = np.concatenate([[False], number[:-1]]) if len(number) else number
        unit = (kind == UNIT) & after
        inside = np.concatenate([[False], ~ends[:-1]]) if len(ends) else ends
        self.name = title & inside & ~number & ~unit
        self.plain = vocabulary.hash[codes].copy()
        self.plain[number] = MARK[NUMBER]
        self.plain[unit] = MARK[UNIT]
        self.slot = number
        self.fixed = ~number & ~unit
        self.exact = vocabulary.exact[every]
        self.literal = np.zeros(len(every), dtype=bool)
        self.literal[kept] = self.fixed
        stands = self.exact != 0
        self.exact, self.literal = self.exact[stands], self.literal[stands]

    def channels(self, n: int):
        """(channels, window hashes, where they start, slots): names kept for channel 0 and replaced for 1, together in windows that have none."""
        hashes, at = _windows(self.plain, self.fixed, n)
        if not self.name.any():
            yield (0, 1), hashes, at, self.slot
            return
        holds = np.convolve(self.name, np.ones(n, dtype=np.int64), "valid") > 0 if len(self.name) >= n else np.zeros(0, dtype=bool)  # by start
        yield (0, 1), hashes[~holds[at]], at[~holds[at]], self.slot
        yield (0,), hashes[holds[at]], at[holds[at]], self.slot
        # windows with a name, each cut out by itself
        begin = np.nonzero(holds)[0]
        literal, slot = self.fixed & ~self.name, self.slot | self.name
        sums = np.concatenate([[0], np.cumsum(literal)])
        begin = begin[sums[begin + n] - sums[begin] >= min(LITERAL, n)]
        named = self.plain.copy()
        named[self.name] = MARK["name"]
        yield (1,), hashes_at(named, begin, n), begin, slot

    def slots(self, slot: np.ndarray, at: int, n: int) -> str:
        return SEPARATOR.join(self.words[self.kept[k]].strip(PUNCTUATION).lower() for k in range(at, at + n) if slot[k])


def _windows(hashes: np.ndarray, literal: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n with enough literal words, and where they start."""
    out = window_hashes(hashes, n)
    sums = np.concatenate([[0], np.cumsum(literal)])
    enough = np.nonzero(sums[n:] - sums[:-n] >= min(LITERAL, n))[0] if len(out) else np.zeros(0, dtype=np.int64)
    return out[enough], enough


def _poor(exact: np.ndarray, literal: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words as they stand without enough literal ones, and where they start."""
    if len(exact) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(literal)])
    poor = np.nonzero(sums[n:] - sums[:-n] < min(LITERAL, n))[0]
    return (window_hashes(exact, n)[poor] if len(poor) else np.zeros(0, dtype=np.uint64)), poor


class Known:
    """Membership in a sorted array of hashes, most misses told by a table of bits."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        self.bits[self._slot(hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are known."""
        maybe = np.nonzero(self.bits[self._slot(hashes)])[0]
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


SCHEMA = "id long, channel int, n int, hash long, pos int, slots string"


def windows(rows: DataFrame, lengths: list[int], known=None) -> DataFrame:
    """Windows of rows (id, text): whole short texts, or runs of each of the lengths; of those in known only, if given."""

    def run(batches):
        vocabulary = Vocabulary()
        keep = Known(known.value).places if known is not None else lambda hashes: np.arange(len(hashes))
        for b in batches:
            out = [[] for _ in range(6)]
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, whole = Canonical(vocabulary, text or ""), False
                for n in lengths or [min(WINDOW, len(c.plain))]:
                    if not n:
                        continue
                    for channels, h, at, slot in c.channels(n):
                        whole = whole or len(h) > 0
                        kept = keep(h)
                        for x, p in zip(h[kept].view(np.int64).tolist(), at[kept].tolist()):
                            filled = c.slots(slot, p, n)
                            for channel in channels:
                                for column, value in zip(out, (id_, channel, n, x, p, filled)):
                                    column.append(value)
                # words as they stand: of documents, and of items that have no other window
                for n in lengths or ([min(WINDOW, len(c.exact))] if len(c.kept) and not whole else []):
                    if not n:
                        continue
                    h, at = _poor(c.exact, c.literal, n)
                    kept = keep(h)
                    for x, p in zip(h[kept].view(np.int64).tolist(), at[kept].tolist()):
                        for column, value in zip(out, (id_, EXACT, n, x, p, "")):
                            column.append(value)
                if len(out[0]) > 100_000:
                    yield batch(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield batch(out)

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "channel", "n", "hash", "pos", "slots"])

    return bounded(rows.where("id is not null")).mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, channel-wise best) pairs: documents (doc_id, text) that hold items (item_id, text).

    Columns: doc_id, item_id, matched (windows of the item found), windows (that it has), coverage, changed
    (different slots whose value is another in the document).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    of_items = saved(windows(items, []), "item-windows")
    lengths = sorted(r.n for r in of_items.select("n").distinct().collect()) or [WINDOW]  # at most five
    hashes = of_items.select("hash").distinct()
    known, n = None, hashes.count()
    if n <= FILTER:
        values = np.array([r.hash for r in hashes.toLocalIterator()], dtype=np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(values))
    placed = F.when(F.col("slots") == "", 0).otherwise(F.col("pos"))  # only slots need a place
    found = windows(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), lengths, known)
    found = saved(found.withColumnRenamed("id", "doc_id").withColumn("pos", placed).distinct(), "document-windows")
    total = of_items.groupBy(F.col("id").alias("item_id"), "channel").agg(F.countDistinct("hash").alias("windows"))
    sides = of_items.select(F.col("id").alias("item_id"), "channel", "hash", placed.alias("item_pos"), F.col("slots").alias("item_slots")).distinct()
    small = F.broadcast if of_items.count() <= BROADCAST_ROWS else lambda df: df
    often = found.groupBy("channel", "hash").agg(F.count("*").alias("n"))  # of windows of the benchmark, where the filter is on
    by_rarity = Window.partitionBy("item_id", "channel").orderBy(F.coalesce("n", F.lit(0)), "hash")  # an item's windows
    least = F.col("windows") - F.ceil(F.col("windows") * share - 1e-9) + 1
    rare = sides.select("item_id", "channel", "hash").distinct().join(often, ["channel", "hash"], "left").withColumn("rank", F.row_number().over(by_rarity))
    rare = saved(rare.join(small(total), ["item_id", "channel"]).where(F.col("rank") <= least).select("item_id", "channel", "hash"), "rare-windows")
    candidates = found.select("doc_id", "channel", "hash").join(small(rare), ["channel", "hash"]).select("doc_id", "item_id", "channel").distinct()
    pairs = saved(
        candidates.join(small(sides), ["item_id", "channel"])
        .join(found.select("doc_id", "channel", "hash", "pos", F.col("slots").alias("doc_slots")), ["doc_id", "channel", "hash"])
        .select("doc_id", "item_id", "channel", "hash", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_slots", "doc_slots"),
        "window-pairs",
    )
    drop(found, rare)
    pair = ["doc_id", "item_id", "channel"]
    enough = pairs.groupBy(*pair).agg(F.countDistinct("hash").alias("n")).join(small(total), ["item_id", "channel"]).where(F.col("n") >= F.col("windows") * share - 1e-9)
    pairs = saved(pairs.join(enough.select(*pair), pair, "left_semi"), "window-pairs")
    # what fills the slots, by document, item and distance between their places: at most the item's words each
    keys = ["doc_id", "item_id", "channel", "shift"]
    slots = (
        pairs.where("item_slots <> ''")
        .select(*keys, "item_pos", "doc_slots", F.explode(F.arrays_zip(F.split("item_slots", SEPARATOR).alias("a"), F.split("doc_slots", SEPARATOR).alias("b"))).alias("s"))
        .select(*keys, "item_pos", "doc_slots", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    )
    fills = saved(
        slots.groupBy(*keys, "a", "b")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys, "a")
        .agg(F.max_by("b", F.struct("n", F.col("a") == F.col("b"), "b")).alias("most"), F.count("*").alias("n")),
        "slot-fills",
    )
    against = slots.join(fills.where("n > 1").drop("n"), [*keys, "a"]).where("b <> most").select(*keys, "item_pos", "doc_slots").distinct()
    changed = fills.groupBy(*keys).agg(F.count_if(F.col("a") != F.col("most")).alias("changed"))
    by_shift = pairs.join(against, [*keys, "item_pos", "doc_slots"], "left_anti").select(*keys, "hash").distinct().join(changed, keys, "left")
    matched = by_shift.groupBy("doc_id", "item_id", "channel").agg(F.countDistinct("hash").alias("matched"), F.max(F.coalesce("changed", F.lit(0))).alias("changed"))
    scored = matched.join(small(total), ["item_id", "channel"]).withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("matched") >= F.col("windows") * share - 1e-9)
    best = F.max_by(F.struct("matched", "windows", "coverage", "changed"), F.struct("coverage", F.lit(1) - F.col("channel"))).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.matched", "best.windows", "best.coverage", "best.changed")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that hold no item of the benchmark, with all their columns; those with a null id stay."""
    return without(docs, saved(leaks(docs, benchmark, share).select("doc_id").distinct(), "leaks"))


def op6_benchmark_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
