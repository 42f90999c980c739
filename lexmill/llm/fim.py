"""Fill-in-middle: texts cut in three at seeded units and written prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

Texts that several documents share are an index of their own. Documents are counted by hash and size of
their text; the texts of keys that occur more than once are grouped by content (Spark compares the bytes), the copies within a task
before the shuffle, and each different text gets its boundary list once: the byte offsets at which its units begin, as an
Elias-Fano sequence, that is low bits as they are and high bits in unary with counts for select. The list is joined back to the documents
that share the text, in lots of about ``LOT`` documents, so a text that a third of all documents share is dealt to many tasks; only
ids are shuffled for it. A hash that two different texts share is no group: those documents are
handled like the rest, whose text no other has and whose list is made where the text is, without a shuffle of any text.

A document's cuts depend on its id alone: h1 to h4 are the first four groups of eight digits of the hex SHA-256 of
``seed:doc_id``. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text
is left plain if it is empty, holds one of the marks, or h3 % 100 >= rate; otherwise it is spm if h4 % 100 < spm, else psm. Units are
code points, or what a pattern matches from left to right (what lies between two matches goes with the later one, and what is behind the last with the last).

Null texts are empty ones. Null ids have a seed without digits. Repeated rows each give a row. Ties cannot arise. Other columns
are ignored; an empty table gives an empty table. Keys of shared texts are broadcast up to ``BROADCAST_IDS``, beyond that joined by shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded, drop, saved, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
RATE = 90
SPM = 20
SEED = 1
LOT = 4096
#: Bytes between two counts for select, and values that are laid down at once.
BLOCK = 64
STEP = 1 << 20
FLUSH = 8 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
INDEX = "key long, bytes long, copies long, text string, n long, width int, low binary, high binary"


class Boundaries:
    """A rising sequence of ``n`` offsets below ``size`` in Elias-Fano form; ``select(k)`` is the k-th, and ``size`` for k = n."""

    def __init__(self, n: int, size: int, width: int, low: bytes, high: bytes):
        self.n, self.size, self.width = n, size, width
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK)))]) if len(ones) else np.zeros(1, dtype=np.int64)

    @classmethod
    def of(cls, values: np.ndarray, size: int) -> Boundaries:
        n = len(values)
        width = max(0, (size // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (size >> width) + 8) // 8 if n else 0, dtype=np.uint8)
        planes = np.zeros((width, (n + 7) // 8), dtype=np.uint8)
        for at in range(0, n, STEP):  # STEP is a multiple of eight
            part = values[at : at + STEP].astype(np.int64)
            ones = (part >> width) + np.arange(at, at + len(part))
            first = int(ones[0]) & ~7
            bits = np.zeros(int(ones[-1]) - first + 1, dtype=bool)
            bits[ones - first] = True
            packed = np.packbits(bits, bitorder="little")
            high[first >> 3 : (first >> 3) + len(packed)] |= packed
            for j in range(width):
                plane = np.packbits(((part >> j) & 1).astype(bool), bitorder="little")
                planes[j, at >> 3 : (at >> 3) + len(plane)] = plane
        return cls(n, size, width, planes.tobytes(), high.tobytes())

    def select(self, k: int) -> int:
        if k >= self.n:
            return self.size
        block = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK : (block + 1) * BLOCK], bitorder="little")
        at = int(np.flatnonzero(bits)[k - int(self.before[block])]) + block * BLOCK * 8
        stride = (self.n + 7) // 8
        low = sum(((int(self.low[j * stride + (k >> 3)]) >> (k & 7)) & 1) << j for j in range(self.width))
        return ((at - k) << self.width) | low


def starts(raw: bytes, unit: str | None = None) -> np.ndarray:
    """The byte offsets at which the units of a text begin."""
    points = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    if unit is None or not len(points):
        return points
    ends = [0, *(m.end() for m in re.finditer(unit, raw.decode("utf-8", "surrogatepass")) if m.end())]
    if len(ends) > 1:
        ends.pop()  # what is behind the last match goes with it
    return points[np.unique(np.array(ends))]


def boundaries(raw: bytes, unit: str | None = None) -> Boundaries:
    return Boundaries.of(starts(raw, unit), len(raw))


def seeds(doc_id: int | None, seed: int = SEED) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))


class Cutter:
    """Cuts documents of one text, whose boundaries are given."""

    def __init__(self, raw: bytes, index: Boundaries, seed: int, rate: int, spm: int):
        self.raw, self.index, self.seed, self.rate, self.spm = raw, index, seed, rate, spm
        self.plain = not raw or any(m.encode() in raw for m in MARKS)

    def __call__(self, doc_id: int | None) -> tuple:
        raw, n = self.raw, self.index.n
        h1, h2, h3, h4 = seeds(doc_id, self.seed)
        if self.plain or h3 % 100 >= self.rate:
            return doc_id, n, "plain", None, None, raw
        a, b = (self.index.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        p, s, m = (x.encode() for x in MARKS)
        if h4 % 100 < self.spm:
            form, parts = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
        else:
            form, parts = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
        return doc_id, n, form, points(raw[:a]), points(raw[a:b]), b"".join(parts)


def _rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that a Cutter gives, of some FLUSH bytes."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    out: list[list] = [[] for _ in types]
    size = 0
    for row in rows:
        for column, value in zip(out, row):
            column.append(value)
        size += len(row[-1])
        if size > FLUSH or len(out[0]) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in SCHEMA.split(", ")])
            out, size = [[] for _ in types], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in SCHEMA.split(", ")])


def _raw(column) -> Iterator[bytes]:
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def key(text: Column) -> Column:
    return F.xxhash64(text)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text); n counts units, the others code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"key": key(F.col("text")), "bytes": F.octet_length("text").cast("long")})
    keys = saved(docs.select("key", "bytes", "doc_id"), "fim-keys")
    repeats = saved(keys.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "fim-repeats")

    def lists(batches):
        for b in batches:
            made = [boundaries(raw, unit) for raw in _raw(b.column(3))]
            more = [pa.array([x.n for x in made], pa.int64()), pa.array([x.width for x in made], pa.int32()), pa.array([x.low.tobytes() for x in made], pa.binary()), pa.array([x.high.tobytes() for x in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [x.split()[0] for x in INDEX.split(", ")])

    def held(rows: DataFrame, shared: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, ["key", "bytes"], how)

    same = held(docs, repeats, "left_semi").groupBy("key", "bytes", "text").agg(F.count(F.lit(1)).alias("copies"))
    index = saved(bounded(same.select("key", "bytes", "copies", "text")).mapInArrow(lists, INDEX), "fim-index")
    shared = saved(index.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("texts"), F.max("copies").alias("copies")).where("texts = 1").select("key", "bytes", "copies"), "fim-shared")
    drop(repeats)
    lots = F.ceil(F.col("copies") / LOT).cast("int")
    members = held(keys, shared, "inner").withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), lots).cast("int"))
    members = members.groupBy("key", "bytes", "lot").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    dealt = index.join(F.broadcast(shared.select("key", "bytes")) if shared.count() <= BROADCAST_IDS else shared.select("key", "bytes"), ["key", "bytes"], "left_semi").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))

    def alone(batches):
        def rows():
            for b in batches:
                for doc_id, raw in zip(b.column(0).to_pylist(), _raw(b.column(1))):
                    yield Cutter(raw, boundaries(raw, unit), seed, rate, spm)(doc_id)

        return _rows(rows())

    def together(batches):
        def rows():
            for b in batches:
                columns = [c.to_pylist() for c in b.columns[1:]]
                for raw, ids, n, width, low, high in zip(_raw(b.column(0)), *columns):
                    cut = Cutter(raw, Boundaries(n, len(raw), width, low, high), seed, rate, spm)
                    for x in ids:
                        yield cut(x["doc_id"])

        return _rows(rows())

    singles = held(docs, shared, "left_anti").select("doc_id", "text")
    joined = dealt.join(members, ["key", "bytes", "lot"]).select("text", "ids", "n", "width", "low", "high")
    return bounded(singles).mapInArrow(alone, SCHEMA).union(joined.mapInArrow(together, SCHEMA))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone."""
    p, s, m = MARKS
    psm = F.regexp_replace(output, f"(?s)^{p}(.*){s}(.*){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*){p}(.*){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir):
    out = transformed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
),
seeds AS (
    SELECT *, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM drawn
),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM seeds
),
parts AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM cuts),
written AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM written
"""
