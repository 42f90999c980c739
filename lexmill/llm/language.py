"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of ``ORDER`` characters. Its counts cover every labelled text of the learning folds:
words (runs of letters, case folded, longer ones cut after ``LONGEST_WORD`` letters) are counted by language, the
windows of ``ORDER`` characters of each different word, with spaces around it, are weighed by these counts, and the lower orders count
what different characters stand before a run, all by DataFrame aggregations. One discount for each language and order comes from the
runs seen once and twice. Of each language and order those runs are kept whose share of all is at least the same fraction, so that all
together are at most ``MOST`` (some 25 MB), whatever the corpus; what others would have is left to the lower order, so
probabilities still sum to 1. The kept runs are arrays of sorted 64-bit hashes with log probabilities, and others with the weights
of contexts; tasks look up the different windows of a batch's new words at once and remember the sums of words.

A document's cross-entropy in a language is the negative log probability of its words by characters, a space after each word counted; the lowest wins,
of equal ones the language first in order. The score is a logistic share, with one factor on entropies times the root of the length. That factor and,
for each language, the entropy beyond which a text is no text of it (``accepted`` is false: the highest but ``REJECT`` of its own
texts) are calibrated on at most ``CALIBRATION`` texts of at most ``LONGEST`` characters, from the sixteenth part of the learning
rows that the counts leave out. A language with fewer than ``FEWEST`` of them has the limit of all together; with fewer in all, all texts are accepted and the factor is 1.

Rows are learned from if their doc_id's crc32 is not divisible by five and lang is not null; ids, sources and languages are never inputs
of a prediction. A null text, or one without a letter, is ``und`` with score 0 and not accepted; so is every text if there is nothing to
learn from. Null ids are predicted but not learned from; repeated rows count and are predicted each; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, drop, saved, table
from .toxicity import fold

ORDER = 5
MOST = 1 << 20
LONGEST_WORD = 32
CALIBRATION = 2000
LONGEST = 20_000
FEWEST = 20
REJECT = 0.005
#: Characters that an unseen one is drawn from.
ALPHABET = 65_536
MOST_LANGUAGES = 4096
REMEMBERED = 300_000
AT_ONCE = 50_000
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean, entropy double"


def _letters() -> re.Pattern:
    """Runs of letters: of what a word character may be, digits, signs and the other numerals are left out."""
    others, begin = [], None
    for c in range(sys.maxunicode + 2):
        odd = c <= sys.maxunicode and chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()
        if odd and begin is None:
            begin = c
        elif not odd and begin is not None:
            others.append(re.escape(chr(begin)) + "-" + re.escape(chr(c - 1)))
            begin = None
    return re.compile(r"[^\W\d_%s]{1,%d}" % ("".join(others), LONGEST_WORD))


LETTERS = _letters()


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def gram_counts(learn: DataFrame) -> DataFrame:
    """(lang, k, gram, c) of texts (lang, text): occurrences for k = ORDER, numbers of different characters before for smaller k."""
    found = learn.select("lang", F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}{1,%d})" % LONGEST_WORD), F.lit(1))).alias("word"))
    counted = found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    padded = F.concat(F.lit(" " * (ORDER - 1)), F.col("word"), F.lit(" "))
    windows = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    whole = saved(counted.select("lang", "c", F.explode(windows).alias("gram")).groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
    shorter = whole.select("lang", "gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER - 1))).alias("k"))
    shorter = shorter.select("lang", "k", F.expr("right(gram, k)").alias("gram"), F.expr("left(right(gram, k + 1), 1)").alias("before")).distinct()
    shorter = shorter.groupBy("lang", "k", "gram").agg(F.count(F.lit(1)).alias("c"))
    return saved(whole.select("lang", F.lit(ORDER).alias("k"), "gram", "c").unionByName(shorter), "all-grams")


def kept_shares(grams: DataFrame, n_languages: int) -> DataFrame:
    """(lang, k, gram, share): the discounted share of each kept run in its context."""
    n = lambda c: F.count(F.when(F.col("c") == c, 1))
    totals = grams.groupBy("lang", "k").agg(F.sum("c").alias("total"), n(1).alias("n1"), n(2).alias("n2"))
    discount = F.when(F.col("n1") > 0, F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))).otherwise(0.1)
    totals = saved(totals.select("lang", "k", "total", discount.alias("discount")), "gram-totals")  # at most ORDER * MOST_LANGUAGES rows
    context = Window.partitionBy("lang", "k", F.expr("left(gram, k - 1)"))  # one row for each character that may follow
    out = grams.withColumn("sum", F.sum("c").over(context)).join(F.broadcast(totals), ["lang", "k"])
    return out.where(F.col("c") * F.lit(MOST // (ORDER * n_languages)) >= F.col("total")).select("lang", "k", "gram", ((F.col("c") - F.col("discount")) / F.col("sum")).alias("share"))


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def hashes(runs: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of an array of characters."""
    out = np.full(len(runs), runs.shape[1] + 1, dtype=np.uint64)
    for j in range(runs.shape[1]):
        out = (out ^ (runs[:, j].astype(np.uint64) * _FACTORS[j])) * _FACTORS[-1]
        out ^= out >> np.uint64(31)
    return out


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Sorted:
    """Numbers by hash, in sorted arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value or 0) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return there, np.where(there, self.values[at], np.float32(0))


class CharacterModel:
    """One language: log probabilities of runs and log weights of contexts by order."""

    def __init__(self, shares: dict[int, tuple[np.ndarray, np.ndarray]]):
        """shares: by order, an array of runs (one a row) and their shares."""
        self.runs: list[Sorted] = []
        self.contexts: list[Sorted] = []
        for k in range(1, ORDER + 1):
            runs, share = shares.get(k, (np.zeros((0, k), dtype=np.uint32), np.zeros(0)))
            keys, which = np.unique(hashes(runs[:, : k - 1]), return_inverse=True)
            left = np.maximum(1e-6, 1.0 - np.bincount(which, weights=share, minlength=len(keys)))
            lower = np.exp(self.log_probabilities(runs[:, 1:]).astype(np.float64))
            self.runs.append(Sorted(hashes(runs), np.log(share + left[which] * lower)))
            self.contexts.append(Sorted(keys, np.log(left)))

    def log_probabilities(self, runs: np.ndarray) -> np.ndarray:
        """Of the last character of each row after those before it."""
        k = runs.shape[1]
        if k == 0:
            return np.full(len(runs), -np.log(ALPHABET), dtype=np.float32)
        there, out = self.runs[k - 1].find(hashes(runs))
        rest = np.flatnonzero(~there)
        if len(rest):
            part = runs[rest]
            out[rest] = self.contexts[k - 1].find(hashes(part[:, :-1]))[1] + self.log_probabilities(part[:, 1:])
        return out


class Model:
    """The languages in order, a model of each, and the calibration."""

    def __init__(self, shares: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.languages = sorted(shares)
        self.models = [CharacterModel(shares[x]) for x in self.languages]
        self.factor = 1.0
        self.limits = np.full(len(self.languages), np.inf)

    def word_sums(self, some: list[str]) -> np.ndarray:
        """Negative log probabilities of words, a row each, by language."""
        out = np.zeros((len(some), len(self.models)))
        for at in range(0, len(some), AT_ONCE):
            part = some[at : at + AT_ONCE]
            codes = characters("".join(f"{' ' * (ORDER - 1)}{w} " for w in part))
            sizes = np.array([len(w) + 1 for w in part])
            firsts = np.cumsum(sizes) - sizes
            where = np.arange(sizes.sum()) + np.repeat(np.arange(len(part)) * (ORDER - 1), sizes)
            runs = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[where]
            _, index, which = np.unique(hashes(runs), return_index=True, return_inverse=True)
            for j, model in enumerate(self.models):
                out[at : at + len(part), j] = -np.add.reduceat(model.log_probabilities(runs[index]).astype(np.float64)[which], firsts)
        return out

    def calibrate(self, entropies: np.ndarray, sizes: np.ndarray, true: np.ndarray) -> None:
        """From entropies (texts x languages), lengths and the places of the true languages."""
        if len(true) < FEWEST:
            return

        def loss(factor: float) -> float:
            z = -factor * np.sqrt(sizes)[:, None] * entropies
            top = z.max(axis=1)
            return float(np.mean(top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(true)), true]))

        self.factor = min((2.0**e for e in range(-6, 7)), key=loss)
        right = entropies.argmin(axis=1) == true
        lowest = entropies.min(axis=1)
        for j in range(len(self.languages)):
            own = lowest[right & (true == j)]
            own = own if len(own) >= FEWEST else lowest[right]
            if len(own) >= FEWEST:
                self.limits[j] = np.quantile(own, 1 - REJECT)

    def decide(self, entropy: np.ndarray, size: int) -> tuple[str, float, bool, float]:
        j = int(entropy.argmin())
        score = 1.0 / float(np.exp(self.factor * np.sqrt(size) * (entropy[j] - entropy)).sum())
        return self.languages[j], score, bool(entropy[j] <= self.limits[j]), float(entropy[j])


class Reader:
    """Entropies of texts under a model; sums of words seen lately are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages)))

    def learn(self, some: list[list[str]]) -> None:
        if len(self.code) > REMEMBERED:
            self.clear()
        new = list(set().union(*some) - self.code.keys())
        if new:
            at = len(self.code)
            if at + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(new)), self.sums.shape[1]))])
            self.sums[at : at + len(new)] = self.model.word_sums(new)
            self.code.update(zip(new, range(at, at + len(new))))

    def entropies(self, found: list[str]) -> tuple[np.ndarray, int]:
        """Of the learned words of one text, and its length."""
        total, code = np.zeros(self.sums.shape[1]), self.code
        for at in range(0, len(found), 100_000):
            total += self.sums[np.fromiter(map(code.__getitem__, found[at : at + 100_000]), np.int64)].sum(axis=0)
        size = sum(map(len, found)) + len(found)
        return total / max(1, size), size


def learning(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def calibrating(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(16)) == 0


def fit(docs: DataFrame) -> Model:
    """Counts all learning rows but those kept for calibration; the kept runs and the calibration texts, both bounded, come to the driver."""
    rows = learning(docs)
    grams = gram_counts(rows.where(~calibrating(F.col("doc_id"))))
    languages = [r.lang for r in grams.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model({})
    got = kept_shares(grams, len(languages)).toArrow()
    drop(grams)
    shares: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    lang, order = got["lang"].combine_chunks().dictionary_encode(), got["k"].to_numpy()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    codes, names, share = lang.indices.to_numpy(), lang.dictionary.to_pylist(), got["share"].to_numpy()
    for j, name in enumerate(names):
        for k in range(1, ORDER + 1):
            here = np.flatnonzero((codes == j) & (order == k))
            runs = characters("".join(got["gram"].take(pa.array(here)).to_pylist())).reshape(-1, k)
            shares.setdefault(name, {})[k] = (runs, share[here])
    model = Model(shares)
    held = rows.where(calibrating(F.col("doc_id")) & (F.length("text") <= LONGEST) & F.col("lang").isin(languages))
    held = held.withColumn("order", F.xxhash64("doc_id", "lang", "text")).orderBy("order", "doc_id", "lang", "text").limit(CALIBRATION)
    found = [(r.lang, words(r.text)) for r in held.select("lang", "text").collect()]
    found = [x for x in found if x[1]]
    reader = Reader(model)
    reader.learn([w for _, w in found] or [[]])
    measured = [reader.entropies(w) for _, w in found]
    if measured:
        model.calibrate(np.array([e for e, _ in measured]), np.array([n for _, n in measured]), np.array([model.languages.index(x) for x, _ in found]))
    return model


def identified(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, accepted, entropy) of documents (doc_id, text); with reject, texts that are not accepted are ``und`` too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            found = [words(t) for t in b.column(1).to_pylist()]
            if reader.model.languages:
                reader.learn(found or [[]])
            out = []
            for w in found:
                if not w or not reader.model.languages:
                    out.append((UNKNOWN, 0.0, False, None))
                    continue
                lang, score, accepted, entropy = reader.model.decide(*reader.entropies(w))
                out.append((UNKNOWN if reject and not accepted else lang, score, accepted, entropy))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.float64())))], [x.split()[0] for x in SCHEMA.split(", ")])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "entropy")
