"""Links between texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Words are those of ``simhash``. A text is known by the signature of its set of shingles, so
texts of one set are one node (that of texts without words is zero).

SimHash comes first: the fingerprints of ``op9`` and its links of at most 2 bits. What it links is compared whole, and pairs
similar enough are links. As 64 bits cannot show all pairs at this share, what follows finds the others.

Two sets similar enough share a shingle among the first n - ceil(share * n) + 1 of each in any one order of
all shingles (prefix filter). The order here is by how many texts have a shingle, then by hash. How many is
counted over all different texts: tasks send sorted shingle hashes cut into ranges, each range is merged by itself, and what
is kept is, for each of 2 ** ``SLOTS`` classes of hashes, the logarithm of the largest count, and for each of 2 ** ``FINE`` whether
a shingle in it is one of two texts: 8 and 16 MB whatever the corpus. Tasks write them to the shared folder, where Python workers read them; the driver
has only the folder's name. Shingles of a fine class with none are no keys, and a text whose whole prefix is
of such is like no other and is let go. The others, with their sets, are a written table. More shared shingles than classes
make the order coarser and more texts stay; they do not change what is found.

Keys whose texts SimHash has connected are settled. Under the others pairs are not made: each text is compared with the key's *hub*, the text with the smallest share of
shingles that are its own, and those similar enough are linked. Where that leaves texts under one key in different
components, those outside its largest are held against others of the key by bounds that need no sets: sizes, which from what a text may share at all leave a
range for the other's and are joined by classes a factor of ``STEP`` wide, so that pages of one template with a fifth of their own meet none; what two texts share with
the hub and beside it; and the parities of their shingles in ``BITS`` classes, which differ no more than the sets do. Pairs that
pass all are compared whole. So no link between components is lost, and what is not compared is connected already or too
different.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, filesystem, saved, without
from .components import components
from .words import window_hashes

SHINGLE = 5
SHARE = 0.8
SLOTS = 23  # bits of a shingle's class: a table of 8 MB
FINE = 27  # of its fine class: 16 MB of bits
RANGE = 1 << 19  # about so many shingles of the corpus are merged in one range
HELD = 1 << 21  # shingles that a task holds before it sends them
BITS = 1024  # of a set's parities
STEP = 1.02  # between classes of sizes
MOST = 100_000  # words whose hashes a worker keeps


class Shingles:
    """The sorted different hashes of a text's shingles; a text of fewer words is one shingle."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.hash: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.hash) > MOST:
            self.hash.clear()
        for w in set(words).difference(self.hash):
            self.hash[w] = xxhash.xxh64_intdigest(w, 23)
        hashes = np.array([self.hash[w] for w in words], dtype=np.uint64)
        return np.unique(window_hashes(hashes, min(self.shingle, len(words))))


def signature(shingles: np.ndarray) -> int:
    """Of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 29)).view(np.int64)) if len(shingles) else 0


def texts(docs: DataFrame) -> DataFrame:
    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")))


class Ranges:
    """Hashes cut by their first ``bits`` bits into ranges; in a range the next 32 bits are kept. Classes are those of the first ``slots`` bits."""

    def __init__(self, bits: int, slots: int = SLOTS):
        self.bits, self.slots = bits, slots

    def cut(self, hashes: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """(range, hashes that are there once, the others and how often) of each range."""
        h, n = np.unique(hashes >> np.uint64(32 - self.bits), return_counts=True)  # range and rest together
        edges = np.searchsorted(h, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(32))
        rest = h.astype(np.uint32)
        out = []
        for k in np.nonzero(np.diff(edges))[0].tolist():
            part, times = rest[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]
            more = times > 1
            out.append((k, part[~more].tobytes(), np.concatenate([part[more], times[more].astype(np.uint32)]).tobytes()))
        return out

    def merged(self, once: list[bytes], more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes that are there more than once, how often) of one range."""
        other = [np.frombuffer(m, dtype=np.uint32).reshape(2, -1) for m in more]
        h = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in once] + [m[0] for m in other])
        n = np.concatenate([np.ones(sum(map(len, once)) // 4, dtype=np.float64)] + [m[1].astype(np.float64) for m in other])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, dtype=np.int64)
        h, n = h[first], np.add.reduceat(n, first) if len(first) else n
        return h[n > 1], n[n > 1]

    def levels(self, once: list[bytes], more: list[bytes]) -> bytes:
        """One range's part of the table of levels: of each class 0, or the bits of the largest count above 1."""
        return self._levels(*self.merged(once, more))

    def _levels(self, h: np.ndarray, n: np.ndarray) -> bytes:
        table = np.zeros(1 << (self.slots - self.bits), dtype=np.uint8)
        np.maximum.at(table, h >> np.uint32(32 - (self.slots - self.bits)), np.floor(np.log2(n)).astype(np.uint8) + 1)
        return table.tobytes()

    def tables(self, once: list[bytes], more: list[bytes]) -> tuple[bytes, bytes]:
        """One range's parts of the table of levels and of the bits of fine classes."""
        h, n = self.merged(once, more)
        fine = np.zeros(1 << (FINE - self.bits), dtype=np.uint8)
        fine[h >> np.uint32(32 - (FINE - self.bits))] = 1
        return self._levels(h, n), np.packbits(fine).tobytes()


class Levels:
    """Of shingles 0 where no two texts have one of the fine class, or else the level of the class.

    The tables are read from a folder written by ``levels`` when they are first asked for, so what is sent to workers is the folder's name.
    """

    def __init__(self, folder: str, slots: int = SLOTS):
        self.folder, self.slots, self.tables = folder, slots, None

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        table, fine = np.zeros(1 << self.slots, dtype=np.uint8), np.zeros(1 << (FINE - 3), dtype=np.uint8)
        fs, at = filesystem(self.folder)
        for info in fs.get_file_info(FileSelector(at)):
            if not info.base_name.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=1024):
                    for whole, column in ((table, b.column(1)), (fine, b.column(2))):
                        own = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                        whole.reshape(-1, own.shape[1])[b.column(0).to_numpy()] = own
        return table, fine

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = self.read()
        table, bits = self.tables
        at = (shingles >> np.uint64(64 - FINE)).astype(np.int64)
        shared = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return table[(shingles >> np.uint64(64 - self.slots)).astype(np.int64)] * shared


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, bits), written, of each document: signature and SimHash."""
    from .simhash import fingerprint  # which imports this module

    def run(batches):
        shingles = Shingles()
        for b in batches:
            every = b.column(1).to_pylist()
            fps = pa.array([signature(shingles(t)) for t in every], pa.int64())
            bits = pa.array(np.array([fingerprint(t) for t in every], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fps, bits], ["doc_id", "fp", "bits"])

    return saved(texts(docs).mapInArrow(run, "doc_id long, fp long, bits long"), "signatures")


def copies(fps: DataFrame) -> DataFrame:
    """doc_id, written, of documents of which another with a smaller id has the signature; not ids of several texts."""
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    one = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp = other")
    return saved(one.join(first, "fp").where("doc_id > first").select("doc_id"), "copies")


def counted(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """(part, once, more) of ranges of shingles."""
    names, types = ["part", "once", "more"], [pa.int32(), pa.binary(), pa.binary()]

    def sent(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranges.cut(np.concatenate(held))), types)], names)

    def run(batches):
        shingles, seen, held, size = Shingles(), set(), [], 0
        for b in batches:
            for t in b.column(1).to_pylist():
                s = shingles(t)
                if not len(s) or (fp := signature(s)) in seen:
                    continue
                seen.add(fp)
                held.append(s)
                size += len(s)
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return texts(docs).mapInArrow(run, "part int, once binary, more binary")


def levels(parts: DataFrame, ranges: Ranges) -> DataFrame:
    """(part, table, fine), written, of the ranges in parts (part, once, more): the tables that ``Levels`` reads, 24 MB in all."""

    def merge(group: pa.Table) -> pa.Table:
        table, fine = ranges.tables(group.column("once").to_pylist(), group.column("more").to_pylist())
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "table": pa.array([table], pa.binary()), "fine": pa.array([fine], pa.binary())})

    return saved(parts.groupBy("part").applyInArrow(merge, "part int, table binary, fine binary"), "levels")


def parities(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether the shingles in each of so many classes are odd in number, as longs: two sets' differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def candidates(docs: DataFrame, share: float, level) -> DataFrame:
    """(fp, n, own, keys, parity, s), written, of the texts that may be like another: size, shingles that no other has, shared ones of the prefix, parities, all shingles."""
    names = ["fp", "n", "own", "keys", "parity", "s"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    def run(batches):
        levels, shingles, seen = level.value, Shingles(), set()
        out, size = [[] for _ in names], 0
        for b in batches:
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n = len(s)
                if not n:
                    continue
                at = levels(s)
                own = int(np.count_nonzero(at == 0))
                prefix = n - math.ceil(share * n - 1e-9) + 1
                if own >= prefix or (fp := signature(s)) in seen:
                    continue
                seen.add(fp)
                keys = s[np.argsort(at, kind="stable")[own:prefix]]
                for column, value in zip(out, (fp, n, own, keys.view(np.int64), parities(s), s.view(np.int64))):
                    column.append(value)
                size += n
                if size > HELD:
                    yield batch(out)
                    out, size = [[] for _ in names], 0
        if out[0]:
            yield batch(out)

    every = texts(docs).mapInArrow(run, "fp long, n int, own int, keys array<long>, parity array<long>, s array<long>")
    out = saved(every, "candidates")
    again = saved(out.groupBy("fp").count().where("count > 1").select("fp"), "again")  # copies without an id of their own may come once a task
    if again.limit(1).count():
        more, out = out, saved(out.join(again, "fp", "left_anti").unionByName(out.join(again, "fp", "left_semi").dropDuplicates(["fp"])), "candidates")
        drop(more)
    drop(again)
    return out


def compared(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs (a, b) with the numbers of shingles both: n, and all: m."""
    x, y = (of.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.col("na") + F.col("nb")).alias("m"))


def alike(share: float):
    return F.col("n") * (1 + share) >= F.col("m") * share - 1e-6


def simhash_links(fps: DataFrame, of: DataFrame, share: float) -> DataFrame:
    """Links (a, b), written, of signatures whose texts SimHash links and the sets confirm."""
    from .simhash import links  # which imports this module

    least = saved(fps.where("fp <> 0").groupBy("bits").agg(F.min("fp").alias("least")), "least")
    same = fps.join(least, "bits").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    x, y = (least.select(F.col("bits").alias(f"bits{k}"), F.col("least").alias(k)) for k in "xy")
    near = links(least.select(F.col("bits").alias("fp"))).join(x, F.col("a") == F.col("bitsx")).join(y, F.col("b") == F.col("bitsy")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = saved(same.unionByName(near).distinct(), "simhash-pairs")
    out = saved(compared(pairs, of).where(alike(share)).select("a", "b"), "simhash-links")
    drop(least, pairs)
    return out


def hubs(keyed: DataFrame) -> DataFrame:
    """(k, hub) of the keys (k, fp, own, n, root) that texts of different roots share; of keys with the same texts one."""
    by_key = keyed.groupBy("k").agg(F.count("*").alias("texts"), F.bit_xor(F.xxhash64("fp")).alias("which"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "fp")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
    same = by_key.where("low <> high").groupBy("texts", "which", "hub.fp").agg(F.min("k").alias("k"))
    return same.select("k", F.col("fp").alias("hub"))


def across(keyed: DataFrame, hub: DataFrame, roots: DataFrame, star: DataFrame, of: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of texts under one key, in different components, whose bounds leave them similar enough."""
    root = roots.select(F.col("node").alias("fp"), "root")
    placed = keyed.drop("root").join(hub, "k").join(root, "fp", "left").select("k", "hub", "fp", "n", "own", F.coalesce("root", "fp").alias("root"))
    parts = placed.groupBy("k", "root").count().groupBy("k").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("count", "root")).alias("largest")).where("parts > 1")
    with_hub = star.select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.col("n").alias("both"))
    words = [F.col("parity")[j].alias(f"w{j}") for j in range(BITS // 64)]
    split = placed.join(parts.select("k", "largest"), "k").join(with_hub, ["hub", "fp"], "left").withColumn("both", F.coalesce("both", "n"))
    # what it shares with the hub, and what it has beside that and may share with others
    split = split.withColumn("beside", F.greatest(F.lit(0), F.col("n") - F.col("both") - F.when(F.col("fp") == F.col("hub"), 0).otherwise(F.col("own"))))
    split = saved(split.join(of.select("fp", *words), "fp"), "split")
    # of two that are alike, what one may share with any other is at least share / (1 + share) of both sizes: so the other has at most ``most`` shingles,
    # and at least the share of its own. Sizes are cut into classes, and only classes that are possible meet
    level = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    split = split.withColumn("most", F.least((1 + share) / share * (F.col("both") + F.col("beside")) - F.col("n"), F.col("n") / share) + 1e-6)
    x = split.where((F.col("root") != F.col("largest")) & (F.col("most") >= F.col("n") * share - 1e-6))
    x = x.withColumn("level", F.explode(F.sequence(level(F.greatest(F.lit(1.0), F.col("n") * share - 1e-6)), level(F.greatest(F.lit(1.0), F.col("most"))))))
    x, y = x.alias("x"), split.withColumn("level", level(F.col("n"))).alias("y")
    m = F.col("x.n") + F.col("y.n")
    shared = F.least("x.both", "y.both") + F.least("x.beside", "y.beside")
    apart = sum((F.bit_count(F.col(f"x.w{j}").bitwiseXOR(F.col(f"y.w{j}"))) for j in range(BITS // 64)), F.lit(0))
    found = x.join(
        y,
        (F.col("x.k") == F.col("y.k")) & (F.col("x.level") == F.col("y.level")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most")) & (F.col("x.root") != F.col("y.root"))
        & (shared * (1 + share) >= m * share - 1e-6) & (apart * (1 + share) <= m * (1 - share) + 1e-6),
    )
    out = saved(found.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "across")
    drop(split)
    return out


def linked(docs: DataFrame, share: float = SHARE, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, bits) of documents (doc_id, text), written, and (node, root) of the signatures that pairs with a similarity of at least share connect, root the smallest."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = Ranges(min(slots, 20, max(1, (size // 6 // RANGE).bit_length())), slots)  # a word is some six bytes
    fps = fingerprinted(docs)
    later = copies(fps)
    docs = without(docs, later)  # sets are counted and kept once
    tables = levels(counted(docs, ranges), ranges)
    level = docs.sparkSession.sparkContext.broadcast(Levels(tables._lexmill_path, slots))  # the folder's name; a worker reads the tables once
    of = candidates(docs, share, level)
    level.destroy()
    drop(tables)
    first = simhash_links(fps, of, share)
    root = components(first).select(F.col("node").alias("fp"), "root")
    keyed = of.select("fp", "n", "own", F.explode("keys").alias("k")).join(root, "fp", "left")
    keyed = saved(keyed.withColumn("root", F.coalesce("root", "fp")), "keys")
    hub = saved(hubs(keyed), "hubs")
    star = saved(keyed.join(hub, "k").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct(), "star-pairs")
    pairs, star = star, saved(compared(star, of), "star")
    near = star.where(alike(share)).select("a", "b").unionByName(first)
    roots = components(near)
    rest = across(keyed, hub, roots, star, of, share)
    more = saved(compared(rest, of).where(alike(share)).select("a", "b"), "similar")
    if more.limit(1).count():
        roots = joined(roots, more)
    drop(later, of, first, keyed, hub, pairs, star, rest)
    return fps, roots


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b) between nodes."""
    of = roots.select(F.col("node").alias("fp"), "root")
    for c in "ab":
        links = links.join(of, F.col(c) == F.col("fp"), "left").withColumn(c, F.coalesce("root", c)).select("a", "b")
    new = components(links).select(F.col("node").alias("old"), F.col("root").alias("new"))
    every = roots.select("node", "root").unionByName(new.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    return every.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
