"""Ranked lexical search over all documents, scored in integers.

The postings of the terms asked for are a DataFrame bucketed by term: one row for each
(term, document), with the bucket of the term's hash, written once and sorted by bucket and
term, so that a later search for other items reads the row groups of its own terms only. Item terms are joined to
them, each match is scored in 64-bit integers, the scores are summed by item and document, and a
window with row_number keeps the best of each item. Postings are dealt by document before the sum, so the
sum needs no further shuffle, and each task passes on no more than its own best of each item.

Terms are the maximal runs of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased. N, L, df, n,
tf and the weights are those of ``weight``, ``damping`` and ``impact`` below. Statistics cover all documents and come from the
same pass: each document with a term has one posting of the empty term, which is in no text.

Item terms are broadcast up to ``BROADCAST`` rows, which are counted first; beyond that they are joined by
shuffle, each under ``SALTS`` keys, so that a term in every document is dealt to as many tasks.

Null and empty texts, and items without a term, rank nothing and are ranked by nothing. Each row of the documents is a
document: repeated rows are counted and ranked each, and rows with a null doc_id last of equal scores. Item rows with one
item_id are one item with the terms of all; rows with a null item_id are left out. Ties go to the smaller doc_id. Other columns are
ignored; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 256
BROADCAST = 500_000
SALTS = 64
TOP = 50


def terms(text: Column) -> Column:
    """The terms of a text, with repeats."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN, -1), lambda t: t != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def weight(n_documents: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_documents + 2)) / (2 * df + 1).cast("double"))).cast("long")


def damping(n: str, n_documents: int, all_terms: int) -> Column:
    """How strongly a document's length holds back its scores; 100 at the mean length."""
    return F.expr(f"50L + (50L * {n} * {n_documents}L) div {max(1, all_terms)}L")


def impact() -> Column:
    """The score of a match from the columns w, tf and m."""
    return F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, bucket): the terms of items (item_id, text), once each."""
    out = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct()
    return out.withColumn("bucket", bucket(F.col("term")))


class Postings:
    """Written postings with the statistics of all documents.

    ``table`` is (bucket, term, row, doc_id, tf, n), without the empty term's; ``frequencies`` (bucket, term, df).
    """

    def __init__(self, written: DataFrame):
        self.written = written
        self.table = written.where(F.col("term") != "")
        got = written.where(F.col("term") == "").agg(F.count(F.lit(1)), F.sum("n")).first()
        self.n_documents, self.all_terms = got[0], got[1] or 0

    @property
    def frequencies(self) -> DataFrame:
        return self.table.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))

    @classmethod
    def build(cls, docs: DataFrame, asked: DataFrame | None = None) -> Postings:
        """Postings of documents (doc_id, text): of all terms, or of those in asked (term)."""
        split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
        found = split.select("doc_id", "row", F.size("terms").cast("long").alias("n"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
        if asked is not None:
            asked = saved(asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct().withColumn("bucket", bucket(F.col("term"))), "asked-terms")
            if asked.count() <= BROADCAST:
                found = found.join(F.broadcast(asked), "term")
            else:
                salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                found = found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
        else:
            found = found.withColumn("bucket", bucket(F.col("term")))
        out = found.groupBy("bucket", "term", "row", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf"))
        written = saved(out.sortWithinPartitions("bucket", "term"), "postings")
        if asked is not None:
            drop(asked)
        return cls(written)

    def search(self, asked: DataFrame, k: int = TOP) -> DataFrame:
        """(item_id, rank, doc_id, score): the k best documents of each item, asked being (item_id, term, bucket)."""
        weights = self.frequencies.withColumn("w", weight(self.n_documents, F.col("df"))).where("w > 0")
        weighed = saved(asked.join(weights, ["bucket", "term"]).select("term", "w", "item_id"), "weighed-terms")
        dealt = self.table.select("term", "row", "doc_id", "tf", damping("n", self.n_documents, self.all_terms).alias("m"))
        if weighed.count() <= BROADCAST:
            matched = dealt.repartition("row").join(F.broadcast(weighed), "term")
        else:
            salted = weighed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            matched = dealt.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).repartition("row")
        summed = matched.select("item_id", "row", "doc_id", impact().alias("score")).groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
        order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
        return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of items (item_id, text) against documents (doc_id, text)."""
    asked = saved(item_terms(items), "item-terms")
    return Postings.build(docs, asked).search(asked, k)


def op11_ranked_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
held AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM held),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
),
occurrences AS (SELECT row_id, doc_id, n, unnest(terms) AS term FROM held),
postings AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM occurrences GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
matches AS (
    SELECT item_id, row_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS s
    FROM asked JOIN postings USING (term) JOIN weights USING (term), whole
),
scores AS (SELECT item_id, row_id, doc_id, sum(s)::BIGINT AS score FROM matches GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scores
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_id)
QUALIFY rank <= 50
"""
