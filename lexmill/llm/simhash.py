"""SimHash near-duplicate classes.

Fingerprint: a text's A-Z are lower-cased; words are runs of bytes other than
0x20 and 0x09-0x0D; every run of three words joined by one space (repeats count, a
shorter text is one run, an empty one none) is hashed by XXH64 with seed 42; a bit of
the fingerprint is set if it is set in more than half of the hashes.

Links: fingerprints at most ``bits`` apart. The 64 bits are cut into ``blocks`` blocks;
two linked fingerprints share at least ``blocks - bits`` of them, so each choice of that
many blocks is a join key, and pairs under one key are verified by their Hamming
distance. Only different fingerprints are joined: copies share one. A key with more
than ``most`` fingerprints is not paired up; its fingerprints are linked through their
neighbours at half the distance instead (two fingerprints at most 2 apart have a common
one at most 1 from both), which finds the same links with at most 65 fingerprints
around each neighbour. Neither way drops a link.

Null and empty texts have fingerprint zero and link like any other; null ids get a
fingerprint and the component of their class (null if it has no other id); repeated
rows stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import bounded, drop, fresh, saved, table, without
from .components import components

STEP = 1 << 18


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    runs = max(1, n - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, runs, STEP):  # a long text in parts, to bound memory
        part = words[at : at + STEP + shingle - 1]
        cols = [part[k:] for k in range(shingle)] if n >= shingle else None
        hashes = [digest(s, seed) for s in map(join, zip(*cols))] if cols else [digest(join(words), seed)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[counts * 2 > runs]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, two's complement) of documents (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))).mapInArrow(
        run, "doc_id long, fp long"
    )


def masks(blocks: int, shared: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(blocks)]
    whole = [sum(c) for c in combinations(block, shared)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def links(fps: DataFrame, bits: int = 2, blocks: int = 5, most: int = 16) -> DataFrame:
    """Links (a, b) that connect what pairs of different fingerprints (column fp) at most ``bits`` apart connect."""
    if bits != 2:
        raise ValueError("neighbours at half the distance are written for 2 bits")
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, blocks - bits)])).alias("c", "k")
    )
    crowded = saved(keyed.groupBy("c", "k").count().where(F.col("count") > most).select("c", "k"), "crowded-keys")
    sparse = keyed.join(crowded, ["c", "k"], "left_anti")
    x, y = sparse.alias("x"), sparse.alias("y")
    near = x.join(
        y,
        (F.col("x.c") == F.col("y.c"))
        & (F.col("x.k") == F.col("y.k"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [0] + [1 << j if j < 63 else -(1 << 63) for j in range(64)]
    around = (
        keyed.join(crowded, ["c", "k"], "left_semi")
        .select("fp")
        .distinct()
        .select(F.col("fp").alias("a"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("around"))
    )
    dense = around.withColumn("b", F.min("a").over(Window.partitionBy("around"))).where(F.col("a") != F.col("b")).select("a", "b")
    return near.unionByName(dense)


def classes(fps: DataFrame, bits: int = 2, blocks: int = 5, most: int = 16, roots: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) of the different fingerprints in fps (doc_id, fp), component_id the smallest doc_id reachable.

    Reachable by the components given in roots (node, root), or else over links of at most ``bits``.
    """
    first = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(first, bits, blocks, most)) if roots is None else roots
    rooted = saved(first.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id"), "rooted")
    smallest = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    joined = rooted.join(smallest, "root").select(F.col("fp").alias("linked"), "component_id")
    out = saved(
        first.join(joined, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "classes"
    )
    drop(first, rooted, smallest)
    return out


def near_duplicates(docs: DataFrame, bits: int = 2, blocks: int = 5, most: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of documents."""
    fps = saved(fingerprints(docs), "fingerprints")
    found = classes(fps, bits, blocks, most)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, share: float = similar.SHARE) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest doc_id (of rows with one id, any one).

    Classes are those of ``similar``: five-word shingles with a Jaccard similarity of at least ``share``.
    Of classes whose ids are all null one document for each signature stays.
    """
    fps, roots = similar.linked(docs, share)
    found = classes(fps, roots=roots)
    rest = saved(fps.join(found, "fp").where("doc_id <> component_id").select("doc_id"), "duplicates")
    again = saved(fps.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    nulls = fps.where("doc_id is null").limit(1).count()
    drop(fps)
    kept = without(docs, rest) if not nulls else without(docs.where("doc_id is not null"), rest)
    if again.limit(1).count():
        name = fresh()
        one = docs.join(again.withColumnRenamed("doc_id", name), docs["doc_id"] == F.col(name), "left_semi")
        kept = without(kept, again).unionByName(without(one, rest).dropDuplicates(["doc_id"]))
    if nulls:
        name, other = fresh(), fresh()
        fp = F.pandas_udf(lambda s: s.map(lambda t: similar.signature(similar.Shingles()(t.encode()))), "long")
        own = docs.where("doc_id is null").withColumn(name, fp(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        nameless = found.where("component_id is null").select(F.col("fp").alias(other))
        kept = kept.unionByName(own.join(nameless, F.col(name) == F.col(other)).dropDuplicates([name]).drop(name, other))
    return kept


def op9_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
