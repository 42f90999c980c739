"""Packing pieces of documents into sequences of a fixed capacity.

A packing depends on how many pieces there are of each length only, so it is planned
from that histogram (at most ``capacity`` counts, whatever the size of the corpus) on the
driver, as layouts and how often each is used, and then dealt out in parallel: each piece
gets its rank among those of its length, from counts by task, and ranks map to places.
Rows tie freely: pieces of one length may swap places. No piece is dropped or cut here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, saved, table

#: A layout: the lengths in a sequence, in order, and the number of sequences so filled.
Layout = tuple[tuple[int, ...], int]

#: Most rows of rank offsets that are broadcast (about 32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> list[int]:
    """The lengths of a bin that holds the longest piece: of those that leave at most ``slack`` free, or else of the fullest, that with the longest pieces.

    Sums of pieces are the bits of an integer; there is one for the pieces up to each length, and the choice walks back through them.
    """
    longest = max(counts)
    room = capacity - longest
    left = {k: n - (k == longest) for k, n in counts.items() if k <= room}
    lengths = sorted(k for k, n in left.items() if n)
    reach, mask = [1], (1 << (room + 1)) - 1
    for length in lengths:
        sums, n, take = reach[-1], min(left[length], room // length), 1
        while n > 0:
            take = min(take, n)
            sums |= (sums << (length * take)) & mask
            n -= take
            take *= 2
        reach.append(sums)
    least = max(0, min(reach[-1].bit_length() - 1, room - slack))
    chosen, filled = [longest], 0
    for length, shorter in zip(reversed(lengths), reversed(reach[:-1])):
        for n in range(min(left[length], (room - filled) // length), -1, -1):
            at = filled + n * length
            if (shorter & ((1 << (room - at + 1)) - 1)) >> max(0, least - at):
                break
        chosen += [length] * n
        filled += n * length
    return chosen


def taken(counts: dict[int, int], capacity: int, slack: int) -> list[Layout]:
    """Bins taken one kind after the other, each as often as counts allow, until nothing is left."""
    counts, plan = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fullest(counts, capacity, slack)
        uses = {k: chosen.count(k) for k in set(chosen)}
        times = min(counts[k] // n for k, n in uses.items())
        plan.append((tuple(chosen), times))
        for k, n in uses.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return plan


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Takes the fullest combination of what is left, again and again.

    Few pieces of a small corpus may leave bins at the end that nothing fills. While more bins are used than the tokens need, the
    same is tried with a slack of 1, 2, 4 and so on allowed to each bin (relaxed minimum bin slack), which keeps short pieces for the end; the best
    plan is returned, of equal ones the first.
    """
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    plans: list[tuple[int, list[Layout]]] = []
    for slack in [0, *(1 << k for k in range(capacity.bit_length()))]:
        plan = taken(counts, capacity, slack)
        plans.append((sum(times for _, times in plan), plan))
        if plans[-1][0] <= least:
            break
    return min(plans, key=lambda p: p[0])[1]


class CapacityTree:
    """A segment tree over remaining capacities: the smallest with an open bin that is at least a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: dict[int, list] = {}

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += n
            at //= 2

    def put(self, room: int, layout: tuple[int, ...], times: int) -> None:
        if times:
            self.bins.setdefault(room, []).append((layout, times))
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, tuple[int, ...], int] | None:
        at = length + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.size
        layout, times = self.bins[room].pop()
        self._add(room, -1)
        return room, layout, times


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best fit decreasing over classes of like bins: the longest pieces first, each into the fullest bin with room.

    A bin that took a piece is the fullest that can take the next of that length, so it
    takes as many as fit before another; like bins therefore move together.
    """
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    tree = CapacityTree(capacity)
    for length in sorted((k for k in counts if counts[k]), reverse=True):
        left, done = counts[length], []
        while left:
            room, layout, times = tree.take(length) or (capacity, (), -1)
            each = room // length
            full = left // each if times < 0 else min(times, left // each)
            done.append((room - each * length, layout + (length,) * each, full))
            left -= full * each
            if left and (times < 0 or full < times):
                done.append((room - left * length, layout + (length,) * left, 1))
                left, full = 0, full + 1
            if times > 0:
                tree.put(room, layout, times - full)
        for bin in done:
            tree.put(*bin)
    return [b for group in tree.bins.values() for b in group]


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go, by rank: parallel arrays sorted by (length, first rank)."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    RANKS = 1 << 48

    @staticmethod
    def of(plan: list[Layout]) -> Places:
        rows, used, base = [], {}, 0
        for layout, times in plan:
            offset = 0
            for length in layout:
                first = used.get(length, 0)
                used[length] = first + times
                rows.append((length * Places.RANKS + first, first, base, offset))
                offset += length
            base += times
        rows.sort()
        return Places(*(np.array([r[k] for r in rows], dtype=np.int64) for k in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * Places.RANKS + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


PLANNERS = {"minimum_bin_slack": minimum_bin_slack, "best_fit_decreasing": best_fit_decreasing}


def placed(cut: DataFrame, capacity: int, planner: str) -> DataFrame:
    """Adds sequence_id and offset to a *written* table of pieces (length, task, nth, ...); drops task and nth."""
    by_task = cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    by_task = saved(by_task, "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places.of(PLANNERS[planner](counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if by_task.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)
    kept = [c for c in cut.columns if c not in ("task", "nth")]
    ranked = cut.join(ranks, ["task", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = places.find(b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)
    return bounded(ranked).mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024) -> DataFrame:
    """Packs documents (doc_id, text) into few sequences by minimum bin slack.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end token alone; null ids and repeated rows are packed like
    any other row; other columns are ignored; an empty table gives an empty table.
    """
    cut = saved(tokens.pieces(docs, path or tokens.vocabulary_path(), capacity), "pieces")
    return placed(cut, capacity, "minimum_bin_slack")


def op7_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
