"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window is a
word between spaces with its case folded; its distance is the bytes it compresses to
with the ordinary dictionary less those with the toxic one. Windows are padded by zeros,
which cost the same with either, because the compressor finds no match in the last bytes
of its input.

Training: a dictionary's content is what its own class has in more documents than the other
would lead to expect: beginnings of words, whole words included, with a binomial
test (``ALPHA``, divided by the number tested) for the toxic side and plain document
frequency for the ordinary side; the strongest come last, where they are cheapest to refer to. Beginnings have at most ``BEGINNING``
characters, and a dictionary at most ``CONTENT`` bytes, the weakest parts being left out.
Near copies are left out of the training rows by the share of long words that
were seen before. The score is a logistic function of the numbers of different windows at
or above each of ``STEPS`` and of the sum of what exceeds 1, calibrated on labelled rows that
trained neither dictionary.

The fit reads at most ``ROWS`` labelled rows of each class, those of the smallest hash of
doc_id among documents that are there and have at most ``LONGEST`` characters; scoring reads every text whole. Labels,
languages, sources and ids are never inputs of a score. Without labelled rows of both
classes every score is 0.

Null and empty texts get the score of a text without windows. Null ids and repeated rows
are scored like any other. Null labels do not train. Other columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, table

ROWS = 2000
LONGEST = 100_000
ALPHA = 0.01
STEPS = (2, 3, 4, 5)
CONTENT = 1 << 16
BEGINNING = 24
WORD = re.compile(r"[^\W\d_]+")
#: How much more a wrongly rejected text costs than a missed one.
CAUTION = 3.0
PAD = b"\0" * 24
FOLDS = 5


def windows(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def beginnings(words: Iterable[str]) -> set[str]:
    """The words' beginnings of four letters or more, whole words with a space."""
    return {w[:n] for w in words for n in range(4, min(len(w), BEGINNING + 1))} | {w + " " for w in words if len(w) <= BEGINNING}


def originals(texts: list[str], shared: dict[str, str] | None = None) -> list[tuple[str, ...]]:
    """The windows of texts that are no near copies of texts before them; a word of several texts is held once, in shared, and tuples take less than sets."""
    shared = {} if shared is None else shared
    seen: set[str] = set()
    out = []
    for text in texts:
        words = tuple([shared.setdefault(w, w) for w in windows(text)])
        long = {w for w in words if len(w) > 9}
        if words and not (len(long) > 3 and len(long & seen) > len(long) / 2):
            out.append(words)
        seen |= long
    return out


def _tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n at p each."""
    if k <= n * p:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total = 0.0
    for i in range(k, n + 1):
        term = math.exp(log(i))
        total += term
        if term < total * 1e-9:
            break
    return total


def by_initial(*classes: list[tuple[str, ...]]) -> list[list[list[list[str]]]]:
    """Of each class, for each initial letter that any class has, the words of each text that begin with it."""
    out: list[dict[str, list[list[str]]]] = []
    for texts in classes:
        groups: dict[str, list[list[str]]] = {}
        for words in texts:
            own: dict[str, list[str]] = {}
            for w in words:
                own.setdefault(w[0], []).append(w)
            for c, some in own.items():
                groups.setdefault(c, []).append(some)
        out.append(groups)
    letters = sorted(set().union(*out))
    return [[groups.get(c, []) for c in letters] for groups in out]


def content(toxic: list[tuple[str, ...]], ordinary: list[tuple[str, ...]]) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary."""
    counts = []
    for t, o in zip(*by_initial(toxic, ordinary)):  # one letter after the other, to bound memory
        inside = Counter(b for words in t for b in beginnings(words))
        inside = Counter({b: n for b, n in inside.items() if n > 2})
        outside = Counter(b for words in o for b in beginnings(words) & inside.keys())
        counts += [(b, n, outside[b]) for b, n in inside.items()]
    tests = max(1, len(counts))
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    found = [(p, -len(b), b) for b, n, m in counts if (p := _tail(n, n + m, share)) < ALPHA / tests]
    common = Counter(w + " " for t in ordinary for w in t)

    def joined(parts: list[str]) -> bytes:
        out: list[bytes] = []
        size = 0
        for part in parts:  # the strongest first; laid down from the end
            piece = b" " + part.encode()
            if size + len(piece) > CONTENT:
                break
            out.append(piece)
            size += len(piece)
        return b"".join(reversed(out)).rjust(16, b"\n")

    return joined([b for _, _, b in sorted(found)]), joined([w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))])


class Distance:
    """Distances of windows under the two dictionaries; those seen lately are kept."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compress(toxic), self._compress(ordinary)
        self.seen: dict[str, int] = {}

    @staticmethod
    def _compress(raw: bytes):
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        parameters = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, window_log=18, hash_log=16, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zstd.STRATEGY_LAZY2
        )
        dictionary.precompute_compress(compression_params=parameters)
        return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def __call__(self, words: Iterable[str]) -> list[int]:
        seen, out = self.seen, []
        if len(seen) > 200_000:
            seen.clear()
        for w in words:
            d = seen.get(w)
            if d is None:
                window = b" " + w.encode() + b" " + PAD
                d = seen[w] = len(self.ordinary(window)) - len(self.toxic(window))
            out.append(d)
        return out


def features(distances: list[int]) -> list[float]:
    return [1.0, *(min(5.0, float(sum(d >= s for d in distances))) for s in STEPS), min(12.0, float(sum(d - 1 for d in distances if d > 1)))]


class Model:
    """Fitted dictionaries and calibration."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.weights = None
        if not toxic or not ordinary:
            return
        shared: dict[str, str] = {}
        t, o = originals(toxic, shared), originals(ordinary, shared)
        train = lambda rows: [x for i, x in enumerate(rows) if i % 4]
        held = lambda rows: [x for i, x in enumerate(rows) if i % 4 == 0]
        self.contents = content(train(t), train(o))
        distance = Distance(*self.contents)
        x = np.array([features(distance(w)) for w in [*held(t), *held(o)]])
        y = np.array([1.0] * len(held(t)) + [0.0] * len(held(o)))
        self.weights = self._logistic(x, y)
        self.contents = content(t, o)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
        """Weights of a logistic function, none of them negative but the first, the constant, which alone is not drawn to 0.

        A text without any evidence gets the share of toxic rows' weight, which is below a half.
        """
        weight = np.where(y > 0, 1 / max(1, y.sum()), CAUTION / max(1, (1 - y).sum())) * len(y) / (1 + CAUTION)
        kept = list(range(x.shape[1]))
        while True:
            part = x[:, kept]
            w, pull = np.zeros(len(kept)), np.array([1e-6, *[ridge] * (len(kept) - 1)])
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
                grad = part.T @ (weight * (p - y)) + pull * w
                step = np.linalg.solve((part * (weight * p * (1 - p))[:, None]).T @ part + np.diag(pull), grad)
                w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
                if np.abs(step).max() < 1e-8:
                    break
            low = int(np.argmin(w[1:])) + 1 if len(w) > 1 else 0
            if not low or w[low] >= 0:
                out = np.zeros(x.shape[1])
                out[kept] = w
                return out
            del kept[low]

    def score(self, distances: list[int]) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, features(distances))))))))


def fold(doc_id=None):
    return F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most ROWS labelled rows of each class whose fold is not 0 (a bounded sample, brought to the driver)."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    rows = [there.where(F.col("toxic") == y).orderBy("order", "doc_id").limit(ROWS) for y in (0, 1)]
    got = texts.join(F.broadcast(rows[0].unionByName(rows[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.min("order").alias("order"))
    got = sorted(got.collect(), key=lambda r: (r.order, r.doc_id))  # of repeated ids the smallest text
    return Model([r.text for r in got if r.toxic == 1], [r.text for r in got if r.toxic == 0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of documents (doc_id, text)."""

    def run(batches):
        distance = Distance(*model.contents) if model.weights is not None else None
        memo: dict[tuple, float] = {}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if distance is None:
                    out.append(0.0)
                    continue
                key = tuple(features(ds := distance(windows(text))))
                if key not in memo:
                    memo[key] = model.score(ds)
                out.append(memo[key])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)

    # one pass: the text is scored where it is, and nothing is joined
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(*model.contents) if model.weights is not None else None
        for s in parts:
            yield pd.Series([0.0 if distance is None else model.score(distance(windows(t))) for t in s], dtype="float64")

    return bounded(docs).where(score(F.col("text").cast("string")) < 0.5)
