"""BM25 search over chunks: from the chunks themselves or an inverted index, and queries with AND, OR, NOT, phrases, wildcards and boosts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from ..sources import scratch
from .batches import bounded

if TYPE_CHECKING:
    from . import segments

K1, B = 1.2, 0.75
DECIMALS = 6
#: Postings of one bucket of a written index, and the most buckets.
BUCKET_ROWS = 2_000_000
BUCKETS = 4096
#: Postings that one task weighs without a shuffle.
ONE_TASK = 200_000
#: Files into which the postings of a bucket are spread by chunk, so that no term is one task's work.
SPREAD = 4
#: Different terms of all queries that are broadcast.
SENT = 200_000


def analysed(text: Column, analyzer: str = "standard") -> Column:
    if analyzer == "standard":
        return T.tokens(text)
    if analyzer == "stemming":
        return stemming.stems(T.tokens(text))
    raise ValueError(f"unknown analyzer {analyzer!r}")


@dataclass
class TextIndex:
    """postings (term, chunk_id, document_id, tf, length[, positions, df]) and one row of statistics (n, mean_length).

    A built index has the chunks' terms (chunk_id, document_id, terms) at hand, and a query without wildcards is answered from them in
    one pass: each row is reduced to its counts of the query's terms. A written index has the frequency of
    each term in its postings, positions, and its statistics as numbers, so that a query is one scan of its terms, one aggregation and the best rows.
    """

    postings: DataFrame
    statistics: DataFrame
    analyzer: str = "standard"
    buckets: int = 0
    numbers: tuple[int, float] | None = None
    terms: DataFrame | None = None
    segments: segments.Segments | None = None

    def weighed(self, hits: DataFrame, wild: bool = False) -> DataFrame:
        """Postings with their BM25 weight; ``hits`` are all postings of their terms."""
        if "df" not in hits.columns:
            frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
            hits = hits.join(frequency if wild else F.broadcast(frequency), "term")
        if self.numbers:
            n, mean = F.lit(self.numbers[0]), F.lit(self.numbers[1])
        else:
            hits = hits.join(F.broadcast(self.statistics.select("n", "mean_length")))
            n, mean = F.col("n"), F.col("mean_length")
        return hits.withColumn("weight", bm25(F.col("tf"), F.col("length"), F.col("df"), n, mean))

    @staticmethod
    def build(chunks: DataFrame, analyzer: str = "standard") -> TextIndex:
        """From chunks (chunk_id, document_id, text)."""
        terms = bounded(chunks).select("chunk_id", "document_id", analysed(F.col("text"), analyzer).alias("terms"))
        statistics = terms.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length"))
        return TextIndex(counted(terms), statistics, analyzer, terms=terms)

    def with_positions(self) -> DataFrame:
        return self.postings if "positions" in self.postings.columns or self.terms is None else counted(self.terms, positions=True)

    def write(self, path: str, buckets: int | None = None) -> None:
        """Postings with positions by a bucket of the term, sorted, so that a query reads the row groups of its terms."""
        stored(self.with_positions(), buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.statistics.withColumn("analyzer", F.lit(self.analyzer)).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        return opened(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics"))


def bm25(tf: Column, length: Column, df: Column, n: Column, mean: Column) -> Column:
    return (F.log(n / (df + 1)) + 1) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))


def counted(terms: DataFrame, positions: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Postings of (chunk_id, document_id, terms): term, chunk_id, document_id, length, tf, and positions if wanted, which are gathered within one chunk only. If terms (term) are asked for, of those alone."""
    exploded = terms.select("chunk_id", "document_id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    exploded = exploded if asked is None else exploded.join(asked, "term", "left_semi")
    more = [F.sort_array(F.collect_list("position")).alias("positions")] if positions else []
    return exploded.groupBy("term", "chunk_id", "document_id", "length").agg(F.count("*").cast("int").alias("tf"), *more)


def stored(postings: DataFrame, buckets: int | None = None) -> DataFrame:
    """Postings with df and bucket, laid out for writing by bucket."""
    buckets = buckets or min(BUCKETS, max(8, -(-postings.count() // BUCKET_ROWS)))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    rows = postings.drop("df", "bucket", "buckets").join(frequency, "term")
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "buckets": F.lit(buckets)})
    return rows.repartition(min(buckets * SPREAD, 4096), "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")


def opened(postings: DataFrame, statistics: DataFrame) -> TextIndex:
    """An index from written postings, as stored() lays them out, and statistics (n, mean_length, analyzer)."""
    row, first = statistics.first(), postings.select("buckets").first()
    return TextIndex(postings, statistics, row.analyzer, first.buckets if first else 0, (row.n, row.mean_length or 1.0))


def _bucket(term: str, buckets: int) -> int:
    """pmod(xxhash64(term), buckets) without a job."""
    import xxhash

    signed = xxhash.xxh64_intdigest(term.encode(), 42)
    return (signed - (1 << 64) if signed >> 63 else signed) % buckets


#: Fields besides text: ids a hit may be tied to, numbers of the chunk, and those that only a filter reaches.
CONDITIONS, NUMBERS, UNSEARCHED = ("document_id", "chunk_id"), ("page_number", "chunk_index"), ("metadata",)
#: Terms that a wildcard, a range or a fuzzy term is expanded to by the dictionary of a written index; if more match, postings are scanned for them.
EXPANDED = 1024
#: The most edits of a fuzzy term.
EDITS = 2


class QueryError(ValueError):
    """A query that does not parse, or asks for what the index does not have."""


class Query:
    """A parsed query: terms with AND between them by default, OR, NOT or -, "phrases", wild*cards, term^2 boosts and parentheses.

    ``[a TO b]`` and ``{a TO b}`` are ranges of terms, with and without their ends, either of which may be missing; ``a~`` and ``a~2`` terms at most so many edits away
    (one if not said); ``"a b"~3`` a phrase whose words follow each other at a distance of at most three. ``text:`` before any of these is the default
    field; ``document_id:`` and ``chunk_id:`` tie the hits of the other terms to an id, ``page_number:3`` and ``chunk_index:[2 TO 5]`` to
    numbers of the chunk (not inside OR or NOT). Metadata is a matter of filters; a colon after any other word is a mere separator.

    ``classes`` are what stands for several terms, with boosts: ("wild", pattern), ("range", low, high, with low, with high), ("fuzzy", word, edits).
    """

    TOKENS = re.compile(r'\(|\)|(?:[^\s()":\[{]+:)?[\[{][^\[\]{}]*[\]}](?:\^[\d.]+)?|(?:[^\s()":]+:)?"[^"]*"(?:[\^~][\d.]*)*|[^\s()"]+')
    BOOST = re.compile(r"(.+)\^(\d+(?:\.\d+)?)", re.S)
    RANGE = re.compile(r"([\[{])\s*(?:(\S+?)\s+)??TO(?:\s+(\S+?))?\s*([\]}])", re.S)

    def __init__(self, source: str):
        self.terms: dict[str, float] = {}  # with their boosts
        self.classes: dict[tuple, float] = {}
        self.numbers: list[tuple] = []  # (field, low, high, with low, with high)
        self.slop = False  # whether a phrase has a distance
        if source.count('"') % 2:
            raise QueryError("a quote is not closed")
        self.tokens = self.TOKENS.findall(source)
        self.at = 0
        self.depth = 0  # of OR, NOT and parentheses
        self.tree = self._or()
        if self.at != len(self.tokens):
            raise QueryError("unbalanced parenthesis in query")

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _or(self):
        before = len(self.numbers)
        parts = [self._and()]
        while self._peek() == "OR":
            self.at += 1
            parts.append(self._and())
        if len(self.numbers) > before and (len(parts) > 1 or self.depth):
            raise QueryError("numbers of chunks hold for the whole query: not inside OR, NOT or parentheses")
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else ("or", parts) if parts else None

    def _and(self):
        parts = []
        while self._peek() not in (None, ")", "OR"):
            if self._peek() == "AND":
                self.at += 1
                continue
            p = self._unary()
            if p is not None:
                parts.append(p)
        return parts[0] if len(parts) == 1 else ("and", parts) if parts else None

    def _unary(self):
        token = self._peek()
        self.at += 1
        if token == "NOT":
            before = len(self.numbers)
            inner = self._unary() if self._peek() not in (None, ")") else None
            if len(self.numbers) > before:
                raise QueryError("numbers of chunks hold for the whole query: not inside OR, NOT or parentheses")
            return ("not", inner) if inner is not None else None
        if token == "(":
            self.depth += 1
            inner = self._or()
            self.depth -= 1
            if self._peek() != ")":
                raise QueryError("unbalanced parenthesis in query")
            self.at += 1
            return inner
        if token.startswith("-") and len(token) > 1:
            before = len(self.numbers)
            inner = self._word(token[1:])
            if len(self.numbers) > before:
                raise QueryError("numbers of chunks hold for the whole query: not inside OR, NOT or parentheses")
            return ("not", inner) if inner is not None else None
        return self._word(token)

    def _word(self, token: str):
        field, colon, rest = token.partition(":")
        if colon and rest and field in CONDITIONS:
            return ("is", field, rest.strip('"'))
        if colon and rest and field in NUMBERS:
            self.numbers.append((field, *self._range(rest, number=True)))
            return None
        if colon and rest and field in UNSEARCHED:
            raise QueryError(f"{field} is not in the text index: give it as a metadata filter")
        token = rest if colon and rest and field == "text" else token
        boost, edits = 1.0, None
        if m := self.BOOST.fullmatch(token):
            token, boost = m[1], float(m[2])
        if re.fullmatch(r"[\[{].*|.*[\]}]", token, re.S):
            return self._class(("range", *self._range(token)), boost)
        if m := re.fullmatch(r"(.+)~(\d*)", token, re.S):
            token, edits = m[1], int(m[2] or 1)
        elif re.fullmatch(r".+~\d*\.\d+", token, re.S):
            raise QueryError("edits and distances are whole numbers")
        quoted = token.startswith('"')
        if not quoted and re.search(r"[*?]", token) and re.search(r"\w", token):
            if edits is not None:
                raise QueryError("a wildcard has no edits")
            return self._class(("wild", "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in token.lower())), boost)
        if not quoted and edits is not None:
            if edits > EDITS or not re.fullmatch(r"\w+", token):
                raise QueryError(f"fuzzy terms are words with at most {EDITS} edits")
            return self._class(("fuzzy", token.lower(), edits), boost)
        words = [w for w in re.findall(r"[^\W]+(?:\.?[^\W]+)*", token.lower()) if len(w) > 1 and w not in T.STOP_WORDS]
        for w in words:
            self.terms[w] = max(boost, self.terms.get(w, 0.0))
        if not words:
            return None
        if len(words) == 1:
            return ("term", words[0])
        if quoted and edits is not None and edits > 1:
            self.slop = True
            return ("phrase", words, edits)
        return ("phrase", words, 1) if quoted else ("and", [("term", w) for w in words])

    def _class(self, key: tuple, boost: float):
        self.classes[key] = max(boost, self.classes.get(key, 0.0))
        return ("class", key)

    def _range(self, token: str, number: bool = False) -> tuple:
        """(low, high, with low, with high), None for an end that is missing."""
        m = self.RANGE.fullmatch(token)
        if m is None and number and re.fullmatch(r"-?\d+", token):
            return int(token), int(token), True, True
        if m is None:
            raise QueryError(f"not a range: {token}")
        try:
            low, high = (None if x is None else int(x) if number else x.lower() for x in (m[2], m[3]))
        except ValueError:
            raise QueryError(f"not numbers: {token}") from None
        return low, high, m[1] == "[", m[4] == "]"


def within(value: Column, low, high, with_low: bool, with_high: bool) -> Column:
    out = value.isNotNull()
    if low is not None:
        out = out & (value >= low if with_low else value > low)
    if high is not None:
        out = out & (value <= high if with_high else value < high)
    return out


def matches(key: tuple, term: Column) -> Column:
    """Whether a term is of one of a query's classes."""
    if key[0] == "wild":
        start = re.match(r"(?:\\.|\w)*", key[1])[0].replace("\\", "") if not key[1].startswith(".") else ""
        return term.startswith(start) & term.rlike(f"^{key[1]}$")
    if key[0] == "range":
        return within(term, *key[1:])
    return F.length(term).between(len(key[1]) - key[2], len(key[1]) + key[2]) & F.levenshtein(term, F.lit(key[1]), key[2]).between(0, key[2])


def _positive(tree) -> bool:
    """Whether the tree needs some term, so that rows of terms suffice to answer it."""
    if tree is None:
        return False
    kind = tree[0]
    if kind in ("not", "is"):
        return False
    if kind == "and":
        return any(map(_positive, tree[1]))
    if kind == "or":
        return all(map(_positive, tree[1]))
    return True


def plain(tree) -> bool | None:
    """For a tree of nothing but terms under one AND or OR: whether a hit must have all; else None."""
    if tree is not None and (tree[0] == "term" or tree[0] in ("and", "or") and all(t[0] == "term" for t in tree[1])):
        return tree[0] != "or"
    return None


def search(
    index: TextIndex, query: str, limit: int | None = 10, where: Column | None = None, min_score: float = 0.0, inside: DataFrame | None = None, chunks: DataFrame | None = None
) -> DataFrame:
    """(chunk_id, document_id, score) of the best chunks, ties to the smaller chunk_id.

    Statistics are those of the whole index; ``where``, a condition on postings' columns
    (chunk_id, document_id), and ``inside`` (chunk_id), the chunks that may be found, are applied before ranking. A query that asks for numbers of
    the chunk needs ``chunks`` with these columns. A query without a positive term finds nothing.
    """
    parsed = Query(query)
    if parsed.numbers:
        if chunks is None:
            raise QueryError("numbers of chunks are not in the index: the chunks are needed")
        asked = chunks.where(_all([within(F.col(field), *ends) for field, *ends in parsed.numbers])).select("chunk_id")
        inside = asked if inside is None else inside.join(asked, "chunk_id", "left_semi")
    stems = {w: stemming.stem(w) if index.analyzer == "stemming" else w for w in parsed.terms}
    boosts: dict[str, float] = {}
    for w, boost in parsed.terms.items():
        boosts[stems[w]] = max(boost, boosts.get(stems[w], 0.0))
    if index.segments is not None and limit is not None and where is None and plain(parsed.tree) is not None:
        out = index.segments.search(boosts, plain(parsed.tree), limit, inside, min_score)
    else:
        scored = _from_terms if index.terms is not None and not parsed.classes and not parsed.slop else _from_postings
        out = scored(index, parsed, stems, boosts, where).select("chunk_id", "document_id", "score").where(F.col("score") >= min_score)
        out = out if inside is None else out.join(inside, "chunk_id", "left_semi")
    return out.orderBy(F.desc("score"), "chunk_id").limit(limit) if limit is not None else out


def _from_terms(index: TextIndex, parsed: Query, stems: dict[str, str], boosts: dict[str, float], where: Column | None) -> DataFrame:
    """Scores of a query's terms from the chunks' terms, in one pass: chunks with a term go on as counts, the others of a task as one row with their number and length."""
    named = sorted(boosts) if _positive(parsed.tree) else []
    phrases = sorted({tuple(stems[w] for w in p) for p in _phrases(parsed.tree)}) if named else []
    joined = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    tfs, together = [f"tf{k}" for k in range(len(named))], [f"together{k}" for k in range(len(phrases))]
    times = lambda t: F.size(F.filter("terms", lambda x: x == t))
    counts = [times(t).alias(c) for t, c in zip(named, tfs)] + [F.contains(joined, F.lit(f" {' '.join(p)} ")).alias(c) for p, c in zip(phrases, together)]
    rows = index.terms.select("chunk_id", "document_id", F.size("terms").alias("length"), *counts)
    hit = ~_all([F.col(c) == 0 for c in tfs])
    own = {"row": F.monotonically_increasing_id(), "chunk_id": F.col("chunk_id"), "document_id": F.col("document_id")}
    rows = rows.select("length", *tfs, *together, *[F.when(hit, c).alias(name) for name, c in own.items()])
    # both uses below take all that is summed here and filter by it, not by the keys, so they read one exchange
    rows = rows.groupBy(*own).agg(F.count("*").alias("chunks"), F.sum("length").alias("length"), *[F.max(c).alias(c) for c in (*tfs, *together)])
    numbers = rows.agg(F.sum("chunks").alias("n"), (F.sum("length") / F.sum("chunks")).alias("mean_length"), *[F.count_if(F.col(c) > 0).alias(f"df{k}") for k, c in enumerate(tfs)], *[F.count_if(c).alias(f"all_{c}") for c in together])
    place = {t: k for k, t in enumerate(named)}

    def holds(tree) -> Column:
        kind = tree[0]
        if kind == "term":
            return F.col(tfs[place[stems[tree[1]]]]) > 0
        if kind == "is":
            return F.col(tree[1]) == tree[2]
        if kind == "not":
            return ~holds(tree[1])
        if kind == "phrase":
            return F.col(together[phrases.index(tuple(stems[w] for w in tree[1]))])
        out = [holds(t) for t in tree[1]]
        return _all(out) if kind == "and" else ~_all([~x for x in out])

    found = rows.where((F.col("chunks") == 1) & ~_all([F.col(c) == 0 for c in tfs]) & holds(parsed.tree)) if named else rows.where(F.lit(False))
    found = found if where is None else found.where(where)
    each = [bm25(F.col(c), F.col("length"), F.col(f"df{k}"), F.col("n"), F.col("mean_length")) * boosts[t] for k, (t, c) in enumerate(zip(named, tfs))]
    return found.join(F.broadcast(numbers)).withColumn("score", F.round(sum(each, F.lit(0.0)), DECIMALS))  # numbers is one row


def _phrases(tree) -> list[list[str]]:
    if tree is None or tree[0] in ("term", "class", "is"):
        return []
    if tree[0] == "phrase":
        return [tree[1]]
    return [p for t in (tree[1] if tree[0] in ("and", "or") else [tree[1]]) for p in _phrases(t)]


def _from_postings(index: TextIndex, parsed: Query, stems: dict[str, str], boosts: dict[str, float], where: Column | None) -> DataFrame:
    named = sorted(boosts)
    condition = F.col("term").isin(named) if named else F.lit(False)
    more = None
    if parsed.classes:
        of_class = ~_all([~matches(key, F.col("term")) for key in parsed.classes])
        if index.segments is not None:  # the dictionary says which terms these are
            more = [r.term for r in index.segments.frequencies().where(of_class).select("term").limit(EXPANDED + 1).collect()]
        condition = condition | of_class
    if not _positive(parsed.tree):
        condition = F.lit(False)
    if named and not parsed.classes and index.buckets:  # prune partitions of a written index
        condition = condition & F.col("bucket").isin(sorted({_bucket(w, index.buckets) for w in named}))
    phrases = bool(_phrases(parsed.tree))
    if index.segments is not None and (more is None or len(more) <= EXPANDED):
        hits = index.segments.postings(sorted({*named, *(more or [])})).where(condition)
    else:
        hits = (index.with_positions() if phrases else index.postings).where(condition)
    if index.numbers and not parsed.classes and index.numbers[0] * len(named) <= ONE_TASK:
        hits = hits.coalesce(1)  # so few rows at most that one task is faster than a shuffle
    kept = index.weighed(hits, bool(parsed.classes))
    kept = kept if where is None else kept.where(where)
    boost = F.lit(1.0)
    for t, k in boosts.items():
        boost = F.when(F.col("term") == t, k).otherwise(boost) if k != 1 else boost
    for key, k in parsed.classes.items():
        boost = F.when(matches(key, F.col("term")), k).otherwise(boost) if k != 1 else boost
    found = F.collect_set("term").alias("terms")
    extra = [F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")] if phrases else []
    scored = kept.groupBy("chunk_id", "document_id").agg(F.round(F.sum(F.col("weight") * boost), DECIMALS).alias("score"), found, *extra)

    def holds(tree) -> Column:
        kind = tree[0]
        if kind == "term":
            return F.array_contains("terms", stems[tree[1]])
        if kind == "class":
            return F.exists("terms", lambda t: matches(tree[1], t))
        if kind == "is":
            return F.col(tree[1]) == tree[2]
        if kind == "not":
            return ~holds(tree[1])
        if kind == "phrase":
            words = [stems[w] for w in tree[1]]
            at = [F.try_element_at(F.col("at"), F.lit(w)) for w in words]
            ends = at[0]  # where the phrase so far may end
            for a in at[1:]:
                ends = _following(a, ends, tree[2])
            return _all([F.array_contains("terms", w) for w in words]) & F.coalesce(F.size(ends) > 0, F.lit(False))
        out = [holds(t) for t in tree[1]]
        return _all(out) if kind == "and" else ~_all([~x for x in out])

    return scored.where(holds(parsed.tree)) if parsed.tree is not None else scored


def _following(positions: Column, ends: Column, distance: int) -> Column:
    """The positions that come after one of ends, at most so far behind."""
    return F.filter(positions, lambda p: F.exists(ends, lambda e: (p > e) & (p - e <= distance)))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _asked_for(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The postings of the terms asked for. Those of a built index are made and written once, for frequencies, rarest tokens and scores all read them."""
    if index.terms is None:
        return index.postings.join(asked, "term", "left_semi")
    spark = asked.sparkSession
    asked = F.broadcast(asked) if asked.count() <= SENT else asked  # terms that no query asks for are not shuffled
    hits, path = counted(index.terms, asked=asked), scratch.folder(spark, "hits")
    hits.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(hits.schema).parquet(path)


def search_batch(index: TextIndex, queries: DataFrame, limit: int = 10, every: bool = True) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, score) for each of queries (query_id, text), all in one job.

    A query asks for all its different tokens (any of them if not ``every``). If for all, chunks are first those of its rarest token,
    and the others are looked up for them only, so a common token makes no row by itself. Scores are summed before ranking, so the rows that
    meet in one task are those of one query's matches, sorted in the window, never gathered.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("text"), index.analyzer))).alias("term"))
    asked = terms.select("term").distinct()
    hits = index.weighed(_asked_for(index, asked), wild=True)
    hits = hits.select("term", "chunk_id", "document_id", "df", F.col("weight").alias("w"))
    if every:
        often = terms.join(hits.groupBy("term").agg(F.max("df").alias("df")), "term", "left")  # a term without postings has none
        rarest = often.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("term"), F.count("*").alias("wanted"))
        chunks = hits.select("term", "chunk_id").join(rarest, "term").select("query_id", "chunk_id", "wanted")
        scored = chunks.join(terms, "query_id").join(hits, ["term", "chunk_id"]).groupBy("query_id", "chunk_id", "document_id", "wanted")
        scored = scored.agg(F.round(F.sum("w"), DECIMALS).alias("score"), F.count("*").alias("n")).where("n = wanted")
    else:
        scored = hits.join(terms, "term").groupBy("query_id", "chunk_id", "document_id").agg(F.round(F.sum("w"), DECIMALS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "document_id", "score")
